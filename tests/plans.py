"""Looking at plans in tests."""


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final(df) -> str:
    """The plan after it ran, with what adaptive execution made of it."""
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().toString()
