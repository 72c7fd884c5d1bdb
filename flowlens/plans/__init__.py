"""Query plans: registered queries (Spark) and their SQL oracle twins."""
