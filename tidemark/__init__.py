"""tidemark: point-in-time features, contract checks, bulk scoring and
serving-metrics windows, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

from tidemark.operators.features import reconstruct  # noqa: E402,F401
from tidemark.operators.lineage import bundle_lineage, deployment_events  # noqa: E402,F401
from tidemark.operators.metrics import metrics_windows, window_records  # noqa: E402,F401
from tidemark.operators.percentile import nearest_rank  # noqa: E402,F401
from tidemark.operators.pit import AsOf, Rolling, point_in_time  # noqa: E402,F401
from tidemark.operators.serving import predict_requests  # noqa: E402,F401
from tidemark.session import get_session, scale_conf  # noqa: E402,F401
