from .bitmaps import (kpis_all_scopes_from_bitmaps, listen_sums, number_values, user_bitmaps,
                      users_by)
from .materialize import (append_tile_parts, checkpoint_dir, drop_scratch, materialize,
                          materialize_dashboard, reliable_checkpoint, scratch_path,
                          tiles_from_parts, tiles_of)
from .refresh import fingerprints, fresh_parts, fresh_tiles, refresh_parts
from .rollups import (dashboard_tables, kpis_all_scopes, kpis_all_scopes_from_fold,
                      listen_counts, monthly_listening_all_scopes,
                      subscription_breakdown_all_scopes, top_artists_all_scopes,
                      top_songs_all_scopes, user_month_fold)

__all__ = [
    "fingerprints", "fresh_parts", "fresh_tiles", "refresh_parts", "tiles_of",
    "kpis_all_scopes_from_bitmaps", "listen_sums", "number_values", "user_bitmaps", "users_by",
    "append_tile_parts", "checkpoint_dir", "materialize", "materialize_dashboard",
    "drop_scratch", "reliable_checkpoint", "scratch_path", "tiles_from_parts",
    "dashboard_tables", "listen_counts", "user_month_fold", "kpis_all_scopes",
    "kpis_all_scopes_from_fold", "monthly_listening_all_scopes",
    "subscription_breakdown_all_scopes", "top_artists_all_scopes", "top_songs_all_scopes",
]
