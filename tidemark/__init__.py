"""tidemark: Spark-native ingestion, table repair and job-log analytics.

Every operator is a pure ``DataFrame -> DataFrame`` function; the clock
(``as_of``) and every limit are parameters. Actions (counts, writes) happen
only in ``tidemark.sources.io``, ``tidemark.plans`` and the quality gates.
"""

from tidemark.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
