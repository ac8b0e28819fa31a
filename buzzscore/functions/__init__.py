"""Column-level building blocks (built-in expressions and the few Python helpers)."""
