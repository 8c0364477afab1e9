"""Fixed values that must equal the source definitions for results to match.

Event names are the tracked-event strings of the two product surfaces; the
scenario operators refer to milestones by key, so a deployment with other
instrumentation only swaps this table.
"""

# ---- fixed values: tracked event names (Report Center) --------------------
RC_HOME = "RC | User On Home Page"
RC_UPLOAD_CLICKED = "RC | Upload Report Clicked"
RC_UPLOAD_PAGE = "RC | User on Reports Upload Page"
RC_LINEOS = "RC | Lineos Clicked"
RC_VIEW_ALL = "RC | View all Clicked (Reports)"
RC_SCHEDULE_PAGE = "RC | User on Create Schedules Page"
RC_SCHEDULE_CREATED = "RC | Create Report Schedule Clicked"

# ---- fixed values: tracked event names (Intelligence Layer) ---------------
IL_HOME = "INTEL | User on Intelligence Layer Home Page"
IL_BUTTON = "INTEL | Intelligence Layer Button Clicked"
IL_CREATE_RULE = "INTEL | Click Create Rule Button"
IL_SUBSCRIBERS = "INTEL | Subscribers Added to Rule"
IL_SAVE_RULE = "INTEL | Button to Save Rule Clicked"
IL_RESULTS = "INTEL | Click Results tab Button"
IL_EDIT_RULE = "INTEL | Edit Rule Button"
IL_DELETE_RULE = "INTEL | Delete Rule Button"

# ---- fixed values: CRM literals -------------------------------------------
CONTRACT_ACTIVATED = "Activated"
STAGE_CLOSED_LOST = "Closed Lost"
PRODUCT_LINE = "Angles Professional"
PRODUCT_LINE_PATTERN = "%Angles Professional%"
TELEMETRY_PREFIX = "platform:"
HEALTH_POOR = "Poor"
HEALTH_AVERAGE = "Average"

# ---- fixed values: labels --------------------------------------------------
TIER_RED, TIER_AMBER, TIER_GREEN = "RED", "AMBER", "GREEN"
SIGNAL_LOGIN_ONLY = "login-only risk"
SIGNAL_LOW_IL = "low IL engagement"
SIGNAL_HEALTHY = "healthy"

# ---- fixed values: stages and scenario ids, in order ----------------------
STAGES = {
    "Onboarding": ["S1", "S2", "S3", "S4"],
    "Adoption": ["S5", "S6", "S7", "S8", "S9"],
    "Retention": ["S10", "S11", "S12", "S13", "S14"],
    "Offboarding": ["S15", "S16"],
}

# ---- fixed values: mart table names and master flag columns, S1..S16 ------
MART_TABLES = {
    "S1": "MTM_S1_CSM_ASSIGNMENT_HANDOFF",
    "S2": "MTM_S2_LICENSE_KEY_NEVER_USED",
    "S3": "MTM_S3_DOUBLE_HOMEPAGE_CONFUSION",
    "S4": "MTM_S4_FIRST_REPORT_UPLOAD_STALL",
    "S5": "MTM_S5_FEATURE_DISCOVERY_GAP",
    "S6": "MTM_S6_SCHEDULE_CREATION_DROPOFF",
    "S7": "MTM_S7_IL_NEVER_ENTERED",
    "S8": "MTM_S8_RULE_CREATION_FUNNEL",
    "S9": "MTM_S9_FIRST_RULE_FIRED",
    "S10": "MTM_S10_SEAT_UTILIZATION_DROP",
    "S11": "MTM_S11_DORMANT_LICENSED_SEATS",
    "S12": "MTM_S12_LOGIN_WITHOUT_IL",
    "S13": "MTM_S13_IL_ENGAGEMENT_DROP",
    "S14": "MTM_S14_PRE_RENEWAL_SCORECARD",
    "S15": "MTM_S15_LAPSED_MAINTENANCE",
    "S16": "MTM_S16_CANCELLATION_IL_AUDIT",
}
MASTER_TABLE = "MTM_MASTER_ACCOUNT"
MASTER_FLAGS = {
    "S1": "in_s1_csm_not_assigned",
    "S2": "in_s2_license_never_used",
    "S3": "in_s3_homepage_confusion",
    "S4": "in_s4_report_upload_stall",
    "S5": "in_s5_feature_gap",
    "S6": "in_s6_schedule_dropoff",
    "S7": "in_s7_il_never_entered",
    "S8": "in_s8_rule_funnel_failure",
    "S9": "in_s9_first_rule_fired",
    "S10": "in_s10_seat_util_drop",
    "S11": "in_s11_dormant_seats",
    "S12": "in_s12_login_no_il",
    "S13": "in_s13_il_engagement_drop",
    "S14": "in_s14_pre_renewal",
    "S15": "in_s15_lapsed_maintenance",
    "S16": "in_s16_cancellation_audit",
}
# Scenarios whose rows carry a telemetry id and reach the CRM through the bridge.
TELEMETRY_GRAIN = ["S3", "S6", "S7", "S8", "S9", "S12", "S13"]

SCENARIO_IDS = [s for ids in STAGES.values() for s in ids]
STAGE_OF = {s: stage for stage, ids in STAGES.items() for s in ids}
