"""Registered queries over the driver tables."""


def catalog():
    """All registered queries by name."""
    from clipmill.plans import (  # noqa: F401  (importing registers)
        metric_queries, pose_queries, predict_queries, source_queries, split_queries, stream_queries, text_queries,
    )
    from clipmill.plans.registry import CATALOG

    return dict(sorted(CATALOG.items()))
