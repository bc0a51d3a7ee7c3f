"""clickfold: commerce clickstream, order and inventory analytics as Spark DataFrame functions.

Layers (each a sub-package):

* ``sources``    raw table schemas, readers, and the mapping of the test tables onto them
* ``functions``  column-level semantics shared by every metric (timestamp parsing, rates, tiers)
* ``operators``  staging (raw -> typed), keyed scans (running sums, forward fill, lag),
                 session rollups, and the inventory chain (cart map, stock timeline, as-of check)
* ``plans``      the metric queries, published views and dashboard measures
* ``streaming``  incremental staging of landing raw files with Structured Streaming

Every public function takes and returns lazy DataFrames; nothing is collected to the driver.
"""

from clickfold.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
