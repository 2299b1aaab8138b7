"""Schemas of the tables, as DDL."""

OBSERVATIONS = "series_id string, obs_date date, realtime_start date, realtime_end date, value double, source string, fetched_at timestamp"
RELEASE_DATES = "release_id int, release_date date"
REGISTRY = "series_id string, role string, frequency string, label string, units string, scale_to_thousands double, publication_lag_months int, description string"
OBSERVATION_KEY = ("series_id", "obs_date", "realtime_start")
