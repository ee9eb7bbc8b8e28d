from .artists import (artist_by_state, artist_list, artist_state_listens, artist_totals,
                      artists_over, artists_over_count, top_artist_at, top_artists,
                      top_artists_display, top_n)
from .cleaning import (auth_view, clean, complete_rows, drop_null_users, listen_view,
                       null_audit, null_level_rows, null_user_rows, where_clean_equals,
                       with_calendar)
from .dictionary import clean_by_dictionary, repair_by_dictionary, repair_dictionary
from .distinct import distinct_count, distinct_values, row_count, states_list
from .geo import (attach_boundaries, clip_outlying, clip_shapes, exclude_states, in_alaska_box, in_hawaii_box,
                  in_rectangle, listens_bounds, map_join_inline, map_prep, map_scale,
                  only_state, project_shapes, with_shapes)
from .lookup import attach
from .membership import bloom_words, with_membership
from .pruned import pruned_share, top_artists_pruned, top_pruned
from .scope import NATIONWIDE, in_scope
from .songs import state_songs, top_free_songs, top_paid_songs, top_songs
from .subs import breakdown_labels, subscription_breakdown
from .users import (ever_paid_users, kpi_labels, kpis, monthly_listening,
                    relabel_ever_paid, relabel_ever_paid_filtered, rows_to_join, user_rows)

__all__ = [
    "clip_outlying", "clip_shapes", "project_shapes", "with_shapes",
    "attach", "clean_by_dictionary", "repair_by_dictionary", "repair_dictionary",
    "artist_by_state", "artist_list", "artist_state_listens", "artist_totals", "artists_over",
    "artists_over_count", "top_artist_at", "top_artists", "top_artists_display", "top_n", "auth_view", "clean",
    "complete_rows", "drop_null_users", "listen_view", "null_audit", "null_level_rows",
    "null_user_rows",
    "where_clean_equals", "with_calendar", "distinct_count", "distinct_values", "row_count", "states_list",
    "attach_boundaries", "exclude_states", "in_alaska_box", "in_hawaii_box", "in_rectangle",
    "listens_bounds", "map_join_inline", "map_prep", "map_scale", "only_state", "NATIONWIDE",
    "in_scope", "state_songs", "top_free_songs", "top_paid_songs", "top_songs",
    "breakdown_labels", "subscription_breakdown", "ever_paid_users", "kpi_labels", "kpis",
    "monthly_listening", "relabel_ever_paid", "relabel_ever_paid_filtered", "rows_to_join", "user_rows",
    "bloom_words", "with_membership", "pruned_share", "top_artists_pruned", "top_pruned",
]
