"""rampart: access-log analytics on Spark.

Raw web-server lines go in; typed tables, reject logs, length and label
features, an isolation-forest score, attack classes, dashboard counts and a
block list come out.  Every operator takes and returns a ``DataFrame`` so that
Catalyst plans the whole chain; Python runs inside tasks only to build and
walk the forest trees.
"""

from rampart.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
