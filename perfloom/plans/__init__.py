"""Registered queries over the driver's tables; importing the package registers them all."""

from . import code, extras, findings, joins, lint, orm, profile, review, rollups, roundtrips, scores, stores, symbols  # noqa: F401
