"""Explicit schemas of every table that is read; nothing is inferred."""

REPORT = (
    "report_id string, text string, source string, is_synthetic boolean, reported_at timestamp, "
    "location_hint struct<raw_text:string,latitude:double,longitude:double,precision:string>, metadata map<string,string>"
)
LABEL = (
    "incident_group string, expected_incident_type string, expected_urgency string, expected_people_at_risk boolean, "
    "expected_people_count int, relation_type string, expected_direction string, expected_needs_review boolean, "
    "expected_location_text string, expected_latitude double, expected_longitude double, "
    "expected_required_response array<string>, expected_actionable boolean, notes string"
)
LABELLED = f"event_id string, delay_seconds double, dispatch struct<{REPORT.replace(' string', ':string').replace(' boolean', ':boolean').replace(' timestamp', ':timestamp').replace('location_hint struct', 'location_hint:struct').replace('metadata map', 'metadata:map')}>, ground_truth struct<" + ",".join(
    x.strip().replace(" ", ":", 1) for x in LABEL.split(", ")
) + ">"
PREDICTION = (
    "report_id string, incident_type struct<label:string,confidence:double>, urgency struct<label:string,confidence:double>, "
    "people_at_risk struct<count:int,confidence:double>, processing_status string"
)
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
