"""Query catalog. Importing this package registers every query."""

from . import registry
from . import quality_queries  # noqa: F401
from . import label_queries  # noqa: F401
from . import agreement_queries  # noqa: F401
from . import sampling_queries  # noqa: F401
from . import eval_queries  # noqa: F401
from . import io_queries  # noqa: F401
from . import stream_queries  # noqa: F401
from . import model_queries  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
