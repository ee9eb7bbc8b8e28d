"""Fixed schemas of the event feeds and the US state dimension.

Event feeds are read with an explicit schema: inference costs a full extra
pass over the input, and at scale that pass is as expensive as the query.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Raw listen events (JSON lines); `ts` is epoch milliseconds.
LISTEN_SCHEMA = _struct([
    ("userId", _S), ("lastName", _S), ("firstName", _S), ("gender", _S),
    ("song", _S), ("artist", _S), ("duration", _D),
    ("sessionId", _L), ("itemInSession", _L), ("auth", _S), ("level", _S),
    ("city", _S), ("state", _S), ("zip", _S), ("lat", _D), ("lon", _D),
    ("registration", _L), ("userAgent", _S), ("ts", _L),
])

# Raw auth events (JSON lines).
AUTH_SCHEMA = _struct([
    ("userId", _S), ("lastName", _S), ("firstName", _S), ("gender", _S),
    ("city", _S), ("state", _S), ("zip", _S), ("lat", _D), ("lon", _D),
    ("level", _S), ("sessionId", _L), ("itemInSession", _L),
    ("registration", _L), ("success", _S), ("userAgent", _S), ("ts", _L),
])

# Column order of the listen projection; `level` leaves it as `subscription`.
LISTEN_COLUMNS = [f.name for f in LISTEN_SCHEMA.fields]
AUTH_COLUMNS = [f.name for f in AUTH_SCHEMA.fields]

# Boundary attribute table: one row per state, geometry carried as WKT text.
BOUNDARY_SCHEMA = _struct([("NAME", _S), ("STUSPS", _S), ("geometry", _S)])

# The 50 states and the District of Columbia as (NAME, USPS code),
# then the six territories the territory-inclusive dimension adds.
US_STATES = [
    ("Alabama", "AL"), ("Alaska", "AK"), ("Arizona", "AZ"), ("Arkansas", "AR"),
    ("California", "CA"), ("Colorado", "CO"), ("Connecticut", "CT"),
    ("Delaware", "DE"), ("Florida", "FL"), ("Georgia", "GA"), ("Hawaii", "HI"),
    ("Idaho", "ID"), ("Illinois", "IL"), ("Indiana", "IN"), ("Iowa", "IA"),
    ("Kansas", "KS"), ("Kentucky", "KY"), ("Louisiana", "LA"), ("Maine", "ME"),
    ("Maryland", "MD"), ("Massachusetts", "MA"), ("Michigan", "MI"),
    ("Minnesota", "MN"), ("Mississippi", "MS"), ("Missouri", "MO"),
    ("Montana", "MT"), ("Nebraska", "NE"), ("Nevada", "NV"),
    ("New Hampshire", "NH"), ("New Jersey", "NJ"), ("New Mexico", "NM"),
    ("New York", "NY"), ("North Carolina", "NC"), ("North Dakota", "ND"),
    ("Ohio", "OH"), ("Oklahoma", "OK"), ("Oregon", "OR"), ("Pennsylvania", "PA"),
    ("Rhode Island", "RI"), ("South Carolina", "SC"), ("South Dakota", "SD"),
    ("Tennessee", "TN"), ("Texas", "TX"), ("Utah", "UT"), ("Vermont", "VT"),
    ("Virginia", "VA"), ("Washington", "WA"), ("West Virginia", "WV"),
    ("Wisconsin", "WI"), ("Wyoming", "WY"), ("District of Columbia", "DC"),
]
US_TERRITORIES = [
    ("American Samoa", "AS"), ("Guam", "GU"), ("Northern Mariana Islands", "MP"),
    ("Puerto Rico", "PR"), ("United States Minor Outlying Islands", "UM"),
    ("Virgin Islands, U.S.", "VI"),
]

# lon/lat rectangles the map used to trim Alaska's and Hawaii's
# outlying islands, as ((lon_min, lon_max), (lat_min, lat_max)).
ALASKA_BOX = ((-170.0, -140.0), (50.0, 72.0))
HAWAII_BOX = ((-160.0, -120.0), (0.0, 90.0))
