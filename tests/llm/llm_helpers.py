"""Small document tables."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    """A documents table of (doc_id, text, source) rows, with a column that clashes."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho", "sig", "tau", "ups"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
