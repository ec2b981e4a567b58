"""Explicit schemas: no inference pass over the files. The column names of the record formats."""

EVENTS = (
    "message string, timestamp long, user long, track long, time double, latency double, recommendation long, "
    "experiments map<string,string>"
)
TRACKS = (
    "track long, artist string, title string, genres array<string>, year int, mood string, artist_country string, "
    "artist_genre string, artist_fans double, pop double, recommendations array<long>"
)
USERS = (
    "user long, interests array<long>, interest_neighbours long, consume_bias double, consume_sharpness double, "
    "session_budget long, artist_discount_gamma double, openness double"
)
INTERACTIONS = "user long, track long, time double, timestamp long"
TRIPLETS = "user_id string, song_id string, play_count int"
META = "track_id string, song_id string, artist string, title string"
EMBEDDINGS = "id long, vector array<float>, bias float"

# Defaults of users whose record leaves a setting out.
USER_DEFAULTS = {
    "interest_neighbours": 10,
    "consume_bias": 5.0,
    "consume_sharpness": 1.0,
    "session_budget": 5,
    "artist_discount_gamma": 0.8,
}
