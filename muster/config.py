"""All weights, thresholds and orders in one frozen record; every operator takes it as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# Enumerations, and below the weights, thresholds, points and levels of the rules.
INCIDENT_TYPES = (
    "FLOOD_FLASH_FLOOD", "FIRE_WILDFIRE_EXPLOSION", "STRUCTURAL_COLLAPSE", "EARTHQUAKE_LANDSLIDE",
    "SEVERE_WEATHER_STORM", "MEDICAL_EMERGENCY", "CIVIL_UNREST_ACTIVE_THREAT",
    "UTILITY_INFRASTRUCTURE_FAILURE", "OTHER_GENERAL_INCIDENT",
)
OTHER = "OTHER_GENERAL_INCIDENT"
URGENCIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PRECISIONS = ("UNKNOWN", "APPROXIMATE", "EXACT")
STATUSES = ("NEW", "ANALYZING", "ACTIVE", "NEEDS_REVIEW", "VERIFIED", "ESCALATED", "RESOLVED", "FALSE_REPORT")
RELATIONS = ("INITIAL", "DUPLICATE", "CORROBORATING", "RELATED", "UNCERTAIN")
RESPONSES = ("SEARCH_AND_RESCUE", "MEDICAL_EMS", "FIRE_HAZMAT", "POLICE_SECURITY", "PUBLIC_WORKS_UTILITY")
SOURCES = ("manual", "simulator", "dataset", "other")
UNKNOWN_PLACES = ("unknown", "none", "null", "n/a", "unspecified")


@dataclass(frozen=True)
class Config:
    # correlation
    w_semantic: float = 0.55
    w_temporal: float = 0.20
    w_spatial: float = 0.25
    threshold: float = 0.70
    duplicate_at: float = 0.85
    tau_hours: float = 3.0
    horizon_hours: float = 6.0
    radius_km: float = 2.5
    earth_km: float = 6371.0
    # corroboration and priority
    corroboration_rate: float = 0.45
    w_urgency: float = 0.35
    w_people: float = 0.30
    w_corroboration: float = 0.20
    w_hazard: float = 0.15
    urgency_points: tuple = (("CRITICAL", 100.0), ("HIGH", 75.0), ("MEDIUM", 40.0), ("LOW", 15.0))
    urgency_default: float = 30.0
    hazard_points: tuple = (
        ("STRUCTURAL_COLLAPSE", 100.0), ("FIRE_WILDFIRE_EXPLOSION", 90.0), ("FLOOD_FLASH_FLOOD", 85.0),
        ("CIVIL_UNREST_ACTIVE_THREAT", 80.0), ("EARTHQUAKE_LANDSLIDE", 75.0), ("MEDICAL_EMERGENCY", 70.0),
        ("UTILITY_INFRASTRUCTURE_FAILURE", 45.0), ("OTHER_GENERAL_INCIDENT", 25.0), ("SEVERE_WEATHER_STORM", 25.0),
    )
    hazard_default: float = 25.0
    low_confidence: float = 0.50
    low_confidence_penalty: float = 10.0
    escalated_bonus: float = 15.0
    verified_bonus: float = 10.0
    levels: tuple = (("CRITICAL", 80.0), ("HIGH", 60.0), ("MEDIUM", 35.0))
    # review and classification
    review_confidence: float = 0.60
    confidence_weights: tuple = (0.30, 0.25, 0.20, 0.15, 0.10)


DEFAULT = Config()

# Which status may follow which in review; the rest is rejected.
TRANSITIONS = {
    "ACTIVE": ("VERIFIED", "ESCALATED", "NEEDS_REVIEW", "RESOLVED", "FALSE_REPORT"),
    "NEEDS_REVIEW": ("ACTIVE", "VERIFIED", "ESCALATED", "RESOLVED", "FALSE_REPORT"),
    "VERIFIED": ("ACTIVE", "ESCALATED", "RESOLVED", "FALSE_REPORT"),
    "ESCALATED": ("ACTIVE", "VERIFIED", "RESOLVED"),
    "RESOLVED": ("ACTIVE", "NEEDS_REVIEW"),
    "FALSE_REPORT": (),
    "NEW": (),
    "ANALYZING": (),
}
