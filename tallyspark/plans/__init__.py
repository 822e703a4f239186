"""Queries over the driver tables; importing this package registers all of them."""

from tallyspark.plans import evaluation, feeds, models, players, registry, scouting, seasons, vectors  # noqa: F401
