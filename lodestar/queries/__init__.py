"""Named queries over the test tables, each with the SQL that gives the same rows where there is one."""

from . import decisions, evaluation, landing, learning, projections, relations, shapes, space, streams, surfaces, surveys, terrain, validation  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
