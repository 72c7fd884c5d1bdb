"""Toxicity by Levenshtein automata over a lexicon trie, with context.

The lexicon is learned: words that stand in labelled toxic documents far more
often than chance allows.  Tokens match a term exactly or, if misspelled,
through the term trie walked together with the token's Levenshtein automaton.
The words around each match tell quotation from abuse, and a logistic model
over a document's matches gives its score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import batch, columns, stage
from .quality import labelled_sample

#: Labelled documents that are learned from at most; all documents are scored.
MAX_LABELLED = 20_000
#: Terms of the lexicon at most, the strongest first.
MAX_TERMS = 20_000
#: Tokens on either side of a match that make its context.
WINDOW = 8
#: Distinct tokens whose match a worker remembers at most.
REMEMBERED = 1_000_000

# Signs and words that mark quoted or reported speech, and words
# that address or describe somebody.
QUOTES = ['"', "“", "”", "„", "«", "»", "‘", "’"]
REPORTING = ["said", "says", "say", "wrote", "writes", "quote", "quoted", "quotes", "called", "calls", "reported",
             "according", "term", "word", "sagte", "schrieb", "zitat", "wort", "dit", "écrit", "citation", "mot",
             "dijo", "escribió", "cita", "palabra"]
ADDRESS = ["you", "your", "youre", "u", "are", "du", "dein", "bist", "ihr", "tu", "toi", "vous", "es", "eres", "tú", "usted"]


def edits_allowed(term: str) -> int:
    """Misspellings that a term of this length may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def _shortened(word: str, cuts: int) -> set[str]:
    """The word without any ``cuts`` or fewer of its signs."""
    out = last = {word}
    for _ in range(cuts):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


class Lexicon:
    """The terms in one trie for each number of edits they allow.

    Walking a trie costs far more than a look-up, so two filters that no match
    fails go first.  If a term is cut into ``k + 1`` pieces, ``k`` edits leave
    one unchanged, the first at the token's beginning, the last at its end, or
    one between moved by fewer than ``k`` places.  And words within ``k``
    edits share a form from which at most ``k`` signs are missing.
    """

    def __init__(self, terms: dict[str, float], known: set[str] = frozenset()):
        self.terms, self.known = terms, known
        self.tries: dict[int, dict] = {}
        self.forms: dict[int, set[str]] = {}
        pieces: dict[tuple[int, int], dict[tuple[int, int], set[str]]] = {}
        for t in terms:
            k = edits_allowed(t)
            if not k:
                continue
            node = self.tries.setdefault(k, {})
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            self.forms.setdefault(k, set()).update(_shortened(t, k))
            cut = [len(t) * i // (k + 1) for i in range(k + 2)]
            for size in range(len(t) - k, len(t) + k + 1):
                for i in range(k + 1):
                    moves = (0,) if i == 0 else (size - len(t),) if i == k else range(1 - k, k)
                    for m in moves:
                        a, b = cut[i] + m, cut[i + 1] + m
                        if 0 <= a and b <= size:
                            pieces.setdefault((k, size), {}).setdefault((a, b), set()).add(t[cut[i]:cut[i + 1]])
        # By edits and the token's length: (begin, end) of a piece, the pieces there.
        self.pieces = {key: list(at.items()) for key, at in pieces.items()}
        self.memo: dict = {}

    def match(self, token: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term within its allowed edits; the fewest
        edits, then the heaviest."""
        if token in self.terms:
            return self.terms[token], 0
        if token in self.known:
            return None
        best = None
        for k, trie in self.tries.items():
            if any(token[a:b] in some for (a, b), some in self.pieces.get((k, len(token)), ())) and not \
                    self.forms[k].isdisjoint(_shortened(token, k)):
                for e, term in self._walk(token, trie, k):
                    if best is None or (e, -self.terms[term]) < (best[1], -best[0]):
                        best = (self.terms[term], e)
        return best

    def _walk(self, token: str, trie: dict, k: int):
        """``(edits, term)`` of the trie's terms that the token's Levenshtein
        automaton accepts.  A state is a place in the token and the edits so
        far; both are stepped along together, so a branch that the automaton
        leaves is not searched."""
        end = len(token)
        stack = [(trie, {i: i for i in range(min(k, end) + 1)})]
        while stack:
            node, states = stack.pop()
            if "" in node and end in states:
                yield states[end], node[""]
            for c, below in node.items():
                if c == "":
                    continue
                step: dict[int, int] = {}
                for i, e in states.items():
                    if i < end and token[i] == c:
                        if e < step.get(i + 1, 9):
                            step[i + 1] = e
                    elif e < k and i < end and e + 1 < step.get(i + 1, 9):
                        step[i + 1] = e + 1                   # another sign
                    if e < k and e + 1 < step.get(i, 9):
                        step[i] = e + 1                       # the term has a sign more
                if step:
                    for i in sorted(step):                    # the token has a sign more
                        e = step[i]
                        while e < k and i < end and e + 1 < step.get(i + 1, 9):
                            i, e = i + 1, e + 1
                            step[i] = e
                    stack.append((below, step))


def _plain(text: str | None) -> str:
    text = (text or "").lower()
    for q in QUOTES[1:]:
        if q in text:
            text = text.replace(q, ' " ')
    return text


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([tv.tokens([w.encode()], punctuation=True).hash for w in words]))


FEATURES = ["exact", "quoted_exact", "near", "quoted_near", "addressed", "strongest", "density"]


def features(group: list[bytes], lexicon: Lexicon, cues: tuple[np.ndarray, ...], window: int = WINDOW) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a group."""
    t = tv.tokens(group, punctuation=True)
    out = np.zeros((len(group), len(FEATURES)))
    if not len(t.hash):
        return out
    h, place = np.unique(t.hash, return_index=True)
    memo = lexicon.memo
    if len(memo) > REMEMBERED:
        memo.clear()
    weight, edits = np.zeros(len(h)), np.zeros(len(h), np.int64)
    raw = t.buf.tobytes()
    for i, (key, p) in enumerate(zip(h.tolist(), place.tolist())):
        m = memo.get(key, 0)
        if m == 0:
            m = memo[key] = lexicon.match(raw[t.start[p]:t.end[p]].decode("utf-8", "ignore"))
        if m:
            weight[i], edits[i] = m
    hit_keys = h[weight > 0]
    at = np.flatnonzero(np.isin(t.hash, hit_keys))
    if not len(at):
        return out
    which = np.searchsorted(h, t.hash[at])
    w, e, doc = weight[which], edits[which], t.doc[at]
    around = [np.concatenate(([0], np.cumsum(np.isin(t.hash, c)))) for c in cues]
    low = np.maximum(at - window, t.first[doc])
    high = np.minimum(at + window + 1, t.first[doc + 1])
    quote, report, address = (a[high] - a[low] for a in around)
    # Quoted: quotation marks on both sides, or one of them and a word of report.
    marks = around[0]
    quoted = ((marks[at] - marks[low] > 0) & (marks[high] - marks[at] > 0)) | ((quote > 0) & (report > 0)) | (report > 1)
    add = lambda k, rows, value: np.add.at(out[:, k], doc[rows], value[rows])
    for k, rows in enumerate(((e == 0) & ~quoted, (e == 0) & quoted, (e > 0) & ~quoted, (e > 0) & quoted)):
        add(k, rows, w)
    add(4, (address > 0) & ~quoted, w)
    np.maximum.at(out[:, 5], doc, np.where(quoted, 0, w / (1 + e)))
    out[:, 6] = np.bincount(doc, minlength=len(group)) * 100 / np.maximum(np.diff(t.first), 1)
    return np.log1p(out)


_ROW = pa.schema([("id", pa.int64()), *((f, pa.float64()) for f in FEATURES)])


def _featurise(shared):
    def run(batches):
        lexicon, cues, window = shared.value
        for ids, texts in columns(batches):
            rows = [features(group, lexicon, cues, window) for _, group in tv.chunks([_plain(x) for x in texts])]
            yield batch(_ROW, ids, *(pa.array(c) for c in np.concatenate(rows).T.copy()))
    return run


_TOKEN = pa.schema([("token", pa.string()), ("toxic", pa.int32())])


def _list_tokens(batches):
    for ys, texts in columns(batches):
        for at, group in tv.chunks([_plain(x) for x in texts]):
            t = tv.tokens(group, words=True)
            raw = t.buf.tobytes()
            for d in range(len(group)):
                a, b = t.first[d], t.first[d + 1]
                words = {raw[s:e].decode("utf-8", "ignore") for s, e in zip(t.start[a:b].tolist(), t.end[a:b].tolist())}
                yield batch(_TOKEN, list(words), [ys[at + d]] * len(words))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    intercept: float = -20.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -40, 40)))


def learn_lexicon(labelled: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """Terms from ``labelled(y, text)``: those whose documents are toxic so much
    more often than others that chance would hardly make one such word."""
    tokens = stage(labelled.select("y", "text").mapInArrow(_list_tokens, "token string, toxic int").groupBy("token").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")), "tokens")
    n, toxic = labelled.agg(F.count("*"), F.sum("y")).first()
    size = tokens.count()
    if not n or not toxic or toxic == n:
        return Lexicon({})
    p = toxic / n
    share = F.col("t") / F.col("n")
    surprise = F.col("n") * (share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0))
    strong = tokens.where((share > p) & (share >= 0.5)).withColumn("g", surprise).where(F.col("g") > float(np.log(10 * size)))
    rows = strong.orderBy(F.desc("g"), "token").limit(max_terms).collect()
    odds = lambda r: float(np.log((r.t + 0.5) / toxic) - np.log((r.n - r.t + 0.5) / (n - toxic)))
    terms = {r.token: odds(r) for r in rows if len(r.token) > 1}
    if not terms:
        return Lexicon({})
    # Words that clean documents use are no misspellings, however near.
    shared = labelled.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def near(batches):
        for (words,) in columns(batches):
            hit = [w for w in words if w not in shared.value.terms and shared.value.match(w)]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], ["token"])
    clean = tokens.where((F.col("n") - F.col("t") >= 2) & (share < 0.5)).select("token").mapInArrow(near, "token string")
    return Lexicon(terms, {r.token for r in clean.collect()})    # words of the bounded sample near a term


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS, window: int = WINDOW) -> Model:
    """Lexicon and weights from a bounded sample of labelled documents."""
    sample = stage(labelled_sample(labels, label_col, max_labelled), "sample")
    text = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "id").select("id", "y", "text"), "texts")
    lexicon = learn_lexicon(text, max_terms)
    model = Model(lexicon)
    if not lexicon.terms:
        return model
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, tuple(map(_hashes, (QUOTES[:1], REPORTING, ADDRESS))), window))
    table = text.select("id", "text").mapInArrow(_featurise(shared), _ddl()).join(F.broadcast(sample), "id").toPandas()
    x, y = table[FEATURES].to_numpy(), table["y"].to_numpy(float)
    model.weights, model.intercept = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9),
                               a.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def _ddl() -> str:
    return "id long, " + ", ".join(f"{f} double" for f in FEATURES)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, score, predicted, ...features)`` per row.

    The text is all that counts.  A null or empty text has no match and gets
    the score of such texts; null ids are kept; repeated rows get equal
    scores; extra columns are ignored; an empty table gives an empty one.  A
    model without toxic labels to learn from scores all texts zero.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.lexicon, tuple(map(_hashes, (QUOTES[:1], REPORTING, ADDRESS))), window))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _featurise(shared), _ddl())
    z = F.lit(model.intercept)
    for f, w in zip(FEATURES, model.weights.tolist()):
        z = z + F.col(f) * w
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    rows = rows.withColumn("score", s)
    return rows.select("id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)
