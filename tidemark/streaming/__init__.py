from tidemark.streaming.activation_stream import start_activation_stream  # noqa: F401
from tidemark.streaming.ledger import MetricsLedger, current_windows  # noqa: F401
from tidemark.streaming.metrics_stream import (  # noqa: F401
    start_metrics_stream,
    stream_window_aggregates,
)
from tidemark.streaming.predict_stream import start_prediction_stream  # noqa: F401,E402
