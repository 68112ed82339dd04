"""Parameters of the registered queries."""

MIN_PRICE = 5.0
HORIZONS = (5, 60, 252)
RECENT_START = "1997-06-01"  # start of the recent regime on the example calendar, with 252 rows ahead
REGIMES = [
    ("one_week", 5, None),
    ("sixty_day", 60, None),
    ("one_year", 252, None),
    ("one_year_later", 252, "1998-01-01"),
    ("sixty_day_recent", 60, RECENT_START),
    ("one_year_recent", 252, RECENT_START),
]
SAMPLE_TICKER = "S1A"
SAMPLE_START = "1997-01-01"
SAMPLE_END = "1998-03-31"
