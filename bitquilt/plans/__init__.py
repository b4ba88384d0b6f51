"""Query plans."""


def all_queries():
    """The registry with every query module loaded."""
    from . import q_ensemble, q_features, q_learn, q_members, registry  # noqa: F401

    return registry
