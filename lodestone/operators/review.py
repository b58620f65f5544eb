"""Decisions on actions that a person reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip

REQUEST = "struct<action_requests:array<struct<name:string,args:map<string,string>>>,review_configs:array<struct<action_name:string,allowed_decisions:array<string>>>>"
#: Order in which responses are offered, and in which one is the default.
OFFERED, DEFAULTS = ("edit", "approve", "reject"), ("approve", "reject", "edit")
# fixed messages
NO_RESPONSE, NOT_SELECTED, NO_REASON = "Please enter a response.", "No response selected.", "Please provide a rejection reason."


def _valid(r: Column) -> Column:
    actions = (F.size(r.action_requests) > 0) & F.forall(r.action_requests, lambda a: a["name"].isNotNull() & a.args.isNotNull())
    configs = (F.size(r.review_configs) > 0) & F.forall(r.review_configs, lambda c: c.action_name.isNotNull() & c.allowed_decisions.isNotNull())
    return F.coalesce(actions & configs, F.lit(False))


def first_request(json: Column) -> Column:
    """The request of a JSON text, or the first of an array of them."""
    return F.when(json.rlike(r"^\s*\["), F.get(F.from_json(json, f"array<{REQUEST}>"), F.lit(0))).otherwise(F.from_json(json, REQUEST))


def valid_request(json: Column) -> Column:
    """Whether a JSON text is a request, two non-empty arrays of well-formed entries, or an array that begins with one."""
    return _valid(first_request(json))


def config_for(name: Column, configs: Column, fallback: Column) -> Column:
    """The first config of the action's name, else the one at a 0-based place."""
    return F.coalesce(F.get(F.filter(configs, lambda c: c.action_name == name), F.lit(0)), F.get(configs, fallback))


def offered(allowed: Column) -> Column:
    return F.filter(F.array(*map(F.lit, OFFERED)), lambda d: F.array_contains(allowed, d))


def default_choice(allowed: Column) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, DEFAULTS)), lambda d: F.array_contains(allowed, d)), F.lit(0))


def decision(allowed: Column, selected: Column, reason: Column, edits_made: Column) -> Column:
    """``struct<type, message, error>`` for the selected response."""
    out = lambda t, m, e: F.struct(t.cast("string").alias("type"), m.cast("string").alias("message"), e.cast("string").alias("error"))
    none = F.lit(None)
    given = strip(F.coalesce(reason, F.lit("")))
    return (
        F.when(F.size(offered(allowed)) == 0, out(none, none, F.lit(NO_RESPONSE)))
        .when(~F.coalesce(F.array_contains(offered(allowed), selected), F.lit(False)), out(none, none, F.lit(NOT_SELECTED)))
        .when((selected == "reject") & (given == ""), out(none, none, F.lit(NO_REASON)))
        .when(selected == "reject", out(F.lit("reject"), given, none))
        .when((selected == "edit") & F.array_contains(allowed, "approve") & ~edits_made, out(F.lit("approve"), none, none))
        .otherwise(out(selected, none, none))
    )


def args_changed(args: Column, initial: Column) -> Column:
    return F.exists(F.map_entries(args), lambda e: ~e.value.eqNullSafe(F.element_at(initial, e.key)))


def edited_args(args: Column, edits: Column) -> Column:
    """``args`` with the edited keys replaced."""
    return F.map_concat(F.map_filter(args, lambda k, _: ~F.map_contains_key(edits, k)), edits)


def all_decisions(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """``request_id, complete, decisions``: in the order of the actions, null unless every action has one."""
    joined = actions.join(decisions, ["request_id", "action_no"], "left")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("action_no", "decision"))), lambda d: d.decision), ",")
    done = F.count("decision") == F.count("*")
    return joined.groupBy("request_id").agg(done.alias("complete"), F.when(done, ordered).alias("decisions"))


def all_allow_approve(configs: Column) -> Column:
    return F.forall(configs, lambda c: F.array_contains(c.allowed_decisions, "approve"))


def normalised_interrupts(values: Column) -> Column:
    """Interrupt values without the missing ones."""
    return F.array_compact(values)


def after_decision(status: Column, complete: Column) -> Column:
    """An interrupted thread goes on once all its decisions are there."""
    return F.when((status == "interrupted") & complete, "busy").otherwise(status)


def after_resolve(status: Column) -> Column:
    """A thread whose interrupt is resolved goes to its end, whatever is decided or open."""
    return F.when(status == "interrupted", "idle").otherwise(status)


def interrupt_title(title: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Interrupt "), number.cast("string")))
