"""Analytics over monitoring events, as PySpark DataFrame operators."""

from eventlens.functions.predicates import Filter, apply_filters
from eventlens.functions.settings import REQUIRED, check_session, configure
from eventlens.functions.sql import register_functions
from eventlens.operators.analytics import analytics, gauge, topn
from eventlens.operators.compare import compare
from eventlens.operators.search import (
    Page, data_keys, data_values, decode_data, label_values, matching_events, search_events, search_page, search_total,
)
from eventlens.operators.timeseries import timeseries
from eventlens.plans.session import CLUSTER
from eventlens.schema import EVENT_COLUMNS, EVENT_SCHEMA
from eventlens.sources.ndjson import accepted, ingest_counts, parse_lines, read_lines, rejected, to_lines
from eventlens.sources.summaries import (
    Summary, days_to_summarise, fresh_days, summarise_days, summary_analytics, summary_data_keys, summary_data_values,
    summary_label_values, summary_timeseries,
)
from eventlens.sources.table import (
    append_events, days_to_publish, drop_expired, publish_days, read_batches, read_events, read_ledger, read_live,
    register_view, retained, retained_from,
)
from eventlens.streaming.ingest import BatchCounts, ingest_progress, start_ingest, stream_lines, write_batch
