"""The questions that can be asked about events.

Each returns a DataFrame. A funnel and a page first run a small job that decides how
the rows are spread; everything else is lazy.
"""

from footfall.operators.breakdowns import breakdown
from footfall.operators.events import event_types, events_page, events_page_after
from footfall.operators.funnels import funnel, funnel_totals
from footfall.operators.headers import breakdown_header, funnel_header, series_header
from footfall.operators.identity import identities, with_actor
from footfall.operators.summaries import summary
from footfall.operators.timeseries import time_series, total

__all__ = [
    "breakdown",
    "breakdown_header",
    "event_types",
    "events_page",
    "events_page_after",
    "funnel",
    "funnel_header",
    "funnel_totals",
    "identities",
    "series_header",
    "summary",
    "time_series",
    "total",
    "with_actor",
]
