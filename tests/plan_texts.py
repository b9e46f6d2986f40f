"""Plans as text."""


def executed_plan(frame):
    """The plan that ran, as text."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()
