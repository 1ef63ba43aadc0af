"""Schemas of the model tables and of the decoded feed messages."""

from __future__ import annotations

STATION = "id string, name string, lat double, lon double, lines array<string>, borough string"

FEED_UPDATE = (
    "id long, timestamp timestamp, feed_id string, raw_data string, num_trips int, num_alerts int, "
    "processing_time_ms double"
)

POSITION = (
    "id long, timestamp timestamp, trip_id string, route_id string, line string, direction int, "
    "current_station string, next_station string, arrival_time timestamp, departure_time timestamp, "
    "delay_seconds int, headway_seconds int, dwell_time_seconds int, schedule_adherence double"
)

ANOMALY = (
    "id long, detected_at timestamp, station_id string, line string, anomaly_type string, severity double, "
    "model_name string, model_version string, features map<string,double>, meta_data map<string,string>, "
    "resolved boolean, resolved_at timestamp"
)

MODEL_ARTIFACT = (
    "id long, model_type string, version string, trained_at timestamp, git_sha string, "
    "metrics map<string,double>, hyperparameters map<string,string>, training_samples long, "
    "artifact_path string, is_active boolean"
)

SUBSCRIPTION = "client_id string, line string, station_id string, anomaly_type string"

FEED_MESSAGE = (
    "feed_code string, header struct<timestamp: long>, entity array<struct<id: string, "
    "trip_update: struct<trip: struct<trip_id: string, route_id: string, direction_id: int>, "
    "stop_time_update: array<struct<stop_id: string, arrival: struct<time: long, delay: int>, "
    "departure: struct<time: long>>>>, "
    "alert: struct<header_text: struct<translation: array<struct<text: string>>>>>>"
)

# Column names and defaults of the station file, feed codes, model columns.
STATION_FILE_COLUMNS = ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"]
DEFAULT_LAT = 40.7484
DEFAULT_LON = -73.9857
FEED_CODES = ["1", "A", "B", "G", "J", "L", "N", "SI"]
FEED_INTERVAL_SECONDS = 30
METRIC_COLUMNS = ["headway_seconds", "dwell_time_seconds", "delay_seconds"]

# Output of every detector; the ensemble reads and writes it too.
DETECTION = (
    "station_id string, line string, anomaly_type string, severity double, model_name string, "
    "model_version string, features map<string,double>, meta_data map<string,string>, "
    "source_position_id long, event_time timestamp"
)
DETECTION_COLUMNS = [field.split()[0] for field in DETECTION.replace("map<string,", "map<string;").split(", ")]
