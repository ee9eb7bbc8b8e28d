from .live import (live_artist_state_listens, live_subscription_counts, live_top_artists,
                   read_listen_stream, refresh_clean_table, start_tile)

__all__ = ["live_artist_state_listens", "live_subscription_counts", "live_top_artists",
           "read_listen_stream", "refresh_clean_table", "start_tile"]
