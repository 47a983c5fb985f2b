"""All registered queries of the library's own operators."""

from . import building, chunks, evaluation, files, plans, ranking, scalars, sets, texts  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
