from .dims import state_dim
from .events import (read_auth_events, read_boundaries, read_events, read_listen_events,
                     read_page_view_events, read_status_change_events)
from .ingest import ingest, ingested, list_files, manifest, new_files
from .quarantine import (line_counts, read_auth_events_checked, read_events_checked,
                         read_listen_events_checked, split_json)
from .schemas import (ALASKA_BOX, AUTH_SCHEMA, BOUNDARY_SCHEMA, HAWAII_BOX, LISTEN_SCHEMA,
                      US_STATES, US_TERRITORIES)
from .variant import infer_fields, read_events_inferred, typed_columns

__all__ = [
    "ingest", "ingested", "list_files", "manifest", "new_files",
    "infer_fields", "line_counts", "read_auth_events_checked", "read_events_checked",
    "read_events_inferred", "read_listen_events_checked", "split_json", "typed_columns",
    "state_dim", "read_auth_events", "read_boundaries", "read_events", "read_listen_events",
    "read_page_view_events", "read_status_change_events", "ALASKA_BOX", "AUTH_SCHEMA",
    "BOUNDARY_SCHEMA", "HAWAII_BOX", "LISTEN_SCHEMA", "US_STATES", "US_TERRITORIES",
]
