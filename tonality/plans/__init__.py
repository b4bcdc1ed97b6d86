"""Registered queries (Spark) and their SQL oracles."""


def load_all():
    """Import every query module so that it registers its queries."""
    from tonality.plans import assembly, augmentation, cleaning, evaluation, io, market, reports  # noqa: F401
    from tonality.plans.registry import REGISTRY
    return REGISTRY
