"""Registered query plans (see ``catalog``)."""


def load_all():
    """Import every query module so the registry is complete."""
    from tillcast.plans import q_clean, q_features, q_models, q_profile, q_select, q_sources  # noqa: F401
    return None
