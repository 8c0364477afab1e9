"""Declared schemas of the source roles and of the marts (contracts).

Source roles are the raw tables the scenarios read; names are lower-case
versions of the warehouse columns. A mart contract is the ordered list of
output columns with types; ``operators.quality.contract_check`` compares a
DataFrame against it before publishing.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, DT, TS = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
                         T.BooleanType(), T.DateType(), T.TimestampNTZType())


def struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "login": struct(("account_id", S), ("date", DT)),
    "rc_events": struct(("account_id", S), ("tracked_event_name", S), ("event_time", S)),
    "il_events": struct(("account_id", S), ("tracked_event_name", S), ("event_time", S),
                        ("session_id", S)),
    "license_customer": struct(("customerid", L), ("customername", S), ("salesforceid", S),
                               ("webid", S), ("onmaintenance", B), ("_fivetran_deleted", B)),
    "license_key": struct(("customerid", L), ("assigneduser", S), ("customeremail", S),
                          ("dateassigned", DT), ("lastvalidateddate", DT), ("registered", B),
                          ("deactivated", DT), ("_fivetran_deleted", B)),
    "license_usage": struct(("customerid", L), ("assigneduser", S), ("lastvalidateddate", TS)),
    "account": struct(("id", S), ("name", S), ("type", S), ("channel_type__c", S),
                      ("active_product_lines_c", S), ("customer_success_associate_c", S),
                      ("platform_legacy_id_c", S), ("next_renewal_date_c", DT),
                      ("open_renewable_amount_c", D), ("customer_health_grade_c", S),
                      ("totango_totango_account_health_c", S), ("at_risk_c", B),
                      ("open_support_cases_c", L), ("contract_status_c", S),
                      ("cancellation_date_c", DT), ("_fivetran_deleted", B)),
    "contract": struct(("contract_id", L), ("account_id", S), ("status", S),
                       ("customer_signed_date", DT), ("_fivetran_deleted", B)),
    "opportunity": struct(("id", S), ("account_id", S), ("stage_name", S), ("close_date", DT),
                          ("win_loss_reason_c", S), ("win_loss_sub_reason_c", S),
                          ("product_line_c", S), ("_fivetran_deleted", B)),
    "onboarding": struct(("account_c", S), ("stage_c", S), ("status_c", S)),
    "user": struct(("id", S), ("name", S), ("email", S), ("_fivetran_deleted", B)),
}

_ACCT = [("account_name", S), ("sfdc_account_id", S), ("account_type", S), ("product_lines", S)]

MART_SCHEMAS: dict[str, T.StructType] = {
    "S1": struct(*_ACCT, ("contract_signed_date", DT), ("days_since_signature", I),
                 ("csm_assigned", S), ("onboarding_stage", S), ("onboarding_status", S)),
    "S2": struct(*_ACCT, ("assigned_user", S), ("user_email", S), ("key_assigned_date", DT),
                 ("days_since_assigned", I), ("csm_id", S)),
    "S3": struct(("telemetry_account_id", S), ("last_login_date", DT), ("total_login_days", L),
                 ("ever_reached_rc", I)),
    "S4": struct(("licensing_customer_id", L), *_ACCT, ("first_product_use", TS),
                 ("last_product_use", TS), ("days_since_first_use", I), ("clicked_upload", I),
                 ("reached_upload_page", I)),
    "S5": struct(("licensing_customer_id", L), *_ACCT, ("active_days", L),
                 ("active_span_days", I), ("used_lineos", I), ("used_view_all", I),
                 ("used_schedule", I), ("csm_id", S)),
    "S6": struct(("telemetry_account_id", S), ("first_schedule_page_visit", DT),
                 ("last_schedule_page_visit", DT), ("schedule_page_visits", L),
                 ("completed_schedule", I), ("days_since_first_visit", I)),
    "S7": struct(("telemetry_account_id", S), ("first_rc_event", DT), ("last_rc_event", DT),
                 ("distinct_rc_events", L), ("days_in_rc", I), ("total_il_events", L)),
    "S8": struct(("telemetry_account_id", S), ("visited_il_home", I), ("clicked_il_button", I),
                 ("started_rule", I), ("added_subscriber", I), ("saved_rule", I),
                 ("viewed_results_only", I), ("total_il_sessions", L)),
    "S9": struct(("telemetry_account_id", S), ("first_rule_saved_date", DT),
                 ("last_rule_saved_date", DT), ("total_rules_saved", L),
                 ("last_results_view", DT), ("days_since_first_rule", I)),
    "S10": struct(("licensing_customer_id", L), *_ACCT, ("active_users_prev_30d", L),
                  ("active_users_curr_30d", L), ("utilization_retention_pct", D),
                  ("next_renewal_date", DT), ("arr_at_risk", D), ("csm_id", S)),
    "S11": struct(*_ACCT, ("next_renewal_date", DT), ("days_to_renewal", I), ("arr_at_risk", D),
                  ("total_registered_seats", L), ("dormant_seats", L), ("dormancy_pct", D),
                  ("csm_id", S)),
    "S12": struct(("telemetry_account_id", S), ("login_days_14d", L), ("il_events_14d", L),
                  ("health_signal", S), ("last_login_date", DT)),
    "S13": struct(("telemetry_account_id", S), ("last_rule_save", DT), ("last_results_view", DT),
                  ("last_rule_edit", DT), ("total_rules_saved", L), ("rules_deleted", L),
                  ("days_since_any_il_event", I)),
    "S14": struct(*_ACCT, ("renewal_date", DT), ("days_to_renewal", I), ("arr", D),
                  ("health_grade", S), ("totango_health", S), ("at_risk_flag", B),
                  ("open_cases", L), ("csm_id", S), ("login_days_90d", L),
                  ("il_sessions_all_time", L), ("active_licensed_users_30d", L),
                  ("dormant_seats", L), ("risk_tier", S)),
    "S15": struct(("licensing_customer_id", L), *_ACCT, ("on_maintenance", B),
                  ("last_license_validation", TS), ("days_since_last_use", I),
                  ("users_still_active", L), ("sfdc_contract_status", S),
                  ("cancellation_date", DT), ("next_renewal_date", DT)),
    "S16": struct(("opportunity_id", S), *_ACCT, ("closed_lost_date", DT), ("loss_reason", S),
                  ("loss_sub_reason", S), ("ever_used_intelligence_layer", I),
                  ("ever_saved_rule", I), ("ever_uploaded_report", I),
                  ("last_license_use_date", TS), ("users_at_churn", L)),
}
