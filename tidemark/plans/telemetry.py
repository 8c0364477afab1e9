"""Profiles of the logs: each log is read and shuffled once per refresh.

A refresh that builds every scenario would otherwise scan the RC log for
S3–S7 and S16, the IL log for S7–S9 and S12–S14, S16, the usage log for S4, S5,
S10 and S14–S16, the logins for S3, S12 and S14 and the license keys for S2, S11
and S14. ``telemetry_profiles`` reduces the event logs to one row per account
holding every milestone any scenario needs, usage to one row per seat and day
and from there to one per customer, logins to one row per account and day, and
the keys to those in use (all ``as_of``-independent); ``refresh.run_all`` writes
them to the shared output folder and every scenario reads them (``tel=``
argument).

RC is grouped first by (account, event name) — for the distinct event-name
count — and IL first by (account, session) — for the distinct session
counts. Both first levels spread a hot account over many reducers; every
other measure is mergeable (max / min / sum) into the second level. The same
profiles can be built from the incremental rollup (``streaming.rollup``).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.operators.kernels import (Spec, active_rollup, count_if, distinct, event_date, ever, first, last, milestones, named,
                                        usage_days)
from tidemark.publish.lineage import tagged
from tidemark.sources.registry import Sources

c = F.col


@dataclass(frozen=True)
class Telemetry:
    rc: DataFrame   # one row per RC account_id
    il: DataFrame   # one row per IL account_id
    usage: DataFrame | None = None   # one row per customer, user and day (``kernels.usage_days``)
    login: DataFrame | None = None   # one row per account and day
    use: DataFrame | None = None     # one row per customer (``customer_use``)
    keys: DataFrame | None = None    # the keys in use (``open_keys``)

    def tagged(self) -> "Telemetry":
        """The same frames, named so that lineage can be read from plans."""
        return Telemetry(**{f.name: tagged(profile_name(f.name), getattr(self, f.name)) for f in fields(self)})


def profile_name(name: str) -> str:
    return f"profile_{name}"


def rc_specs(day: Column | None = None, weight: Column | None = None) -> dict[str, Spec]:
    """Measures of the RC profile. ``day`` and ``weight`` name the day and the
    number of events of a row that stands for several (a rollup's)."""
    d = event_date() if day is None else day
    sp, sc = named(V.RC_SCHEDULE_PAGE), named(V.RC_SCHEDULE_CREATED)
    return {
        "rc_home": ever(named(V.RC_HOME)),
        "clicked_upload": ever(named(V.RC_UPLOAD_CLICKED)),
        "reached_upload_page": ever(named(V.RC_UPLOAD_PAGE)),
        "used_lineos": ever(named(V.RC_LINEOS)),
        "used_view_all": ever(named(V.RC_VIEW_ALL)),
        "used_schedule": ever(sp),
        "first_schedule_page_visit": first(sp, d),
        "last_schedule_page_visit": last(sp, d),
        "schedule_page_visits": count_if(sp, weight),
        "completed_schedule": ever(sc),
        "first_rc_event": first(None, d),
        "last_rc_event": last(None, d),
        "distinct_rc_events": distinct(),
    }


def il_specs(day: Column | None = None, weight: Column | None = None) -> dict[str, Spec]:
    """Measures of the IL profile."""
    d = event_date() if day is None else day
    save, results = named(V.IL_SAVE_RULE), named(V.IL_RESULTS)
    has_name = c("tracked_event_name").isNotNull()
    return {
        "il_named": ever(has_name),
        "visited_il_home": ever(named(V.IL_HOME)),
        "clicked_il_button": ever(named(V.IL_BUTTON)),
        "started_rule": ever(named(V.IL_CREATE_RULE)),
        "added_subscriber": ever(named(V.IL_SUBSCRIBERS)),
        "saved_rule": ever(save),
        "viewed_results_only": ever(results),
        "total_il_sessions": distinct(),
        "first_rule_saved_date": first(save, d),
        "last_rule_saved_date": last(save, d),
        "rule_save_events": count_if(save, weight),
        "last_results_view": last(results, d),
        "last_rule_edit": last(named(V.IL_EDIT_RULE), d),
        "save_sessions": distinct(save),
        "delete_sessions": distinct(named(V.IL_DELETE_RULE)),
        "last_il_event": last(None, d),
        "last_named_il_event": last(has_name, d),
    }


# Surface -> measures of its profile and the column whose values they count.
PROFILES = {"RC": (rc_specs, "tracked_event_name"), "IL": (il_specs, "session_id")}


def _with_day(events: DataFrame, day: Column | None) -> tuple[DataFrame, Column]:
    """Events with their parsed day as a column: the text is read once per
    event, not once per measure."""
    return (events, day) if day is not None else (events.withColumn("_day", event_date()), c("_day"))


def rc_profile(rc_events: DataFrame, day: Column | None = None, weight: Column | None = None) -> DataFrame:
    rc_events, day = _with_day(rc_events, day)
    return milestones(rc_events, "account_id", rc_specs(day, weight), PROFILES["RC"][1])


def il_profile(il_events: DataFrame, day: Column | None = None, weight: Column | None = None) -> DataFrame:
    il_events, day = _with_day(il_events, day)
    return milestones(il_events, "account_id", il_specs(day, weight), PROFILES["IL"][1])


def customer_use(usage: DataFrame) -> DataFrame:
    """The usage profile per customer: first and last use, days with any."""
    return active_rollup(usage, "customerid", "lastvalidateddate", last_ts="last_ts")


def open_keys(license_key: DataFrame) -> DataFrame:
    """Keys that are registered and not deactivated, the only ones that any
    scenario asks for."""
    return (license_key.filter((c("registered") == F.lit(True)) & c("deactivated").isNull())
            .select("customerid", "assigneduser", "customeremail", "dateassigned", "lastvalidateddate",
                    "_fivetran_deleted"))


def telemetry_profiles(src: Sources, rollup: DataFrame | None = None) -> Telemetry:
    """Profiles of the logs of ``src``; with ``rollup`` (``read_rollup``) the
    event profiles come from it and the event logs are not read."""
    usage, login = usage_days(src.license_usage), src.login.select("account_id", "date").distinct()
    rest = usage, login, customer_use(usage), open_keys(src.license_key)
    if rollup is None:
        return Telemetry(rc_profile(src.rc_events), il_profile(src.il_events), *rest)
    day, n = c("event_date"), c("events")
    return Telemetry(rc_profile(rollup.filter(c("surface") == "RC"), day, n),
                     il_profile(rollup.filter(c("surface") == "IL"), day, n), *rest)
