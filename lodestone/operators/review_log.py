"""The log of a review: requests, edits, decisions and resolutions, folded in order.

A log row is ``request_id, seq, kind`` with ``action_no``; ``requested`` brings
``args`` and ``allowed``, ``edited`` brings ``args``, ``decided`` a ``choice``
and a ``reason``.  One aggregate folds the rows of a request, in the order of
``seq``, through :data:`TRANSITIONS`: what the table doesn't have for a status
is ignored and counted.  A thread goes on (``busy``) as soon as every requested
action has a decision, and to its end (``idle``) when it is resolved.

Defined cases: an action that is requested again starts anew; an edit or a
decision for an action that nobody requested is ignored; a decision that isn't
allowed or lacks its reason is an error that changes nothing else; rows of an
equal ``seq`` come in the order of kind and action.  A request's rows meet in
one fold, as a person's decisions are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.review import args_changed, decision, edited_args

#: Status before and kind of a row: status behind it.  Decisions that complete a request lead on to ``busy``.
TRANSITIONS = {
    ("none", "requested"): "interrupted",
    ("interrupted", "requested"): "interrupted",
    ("interrupted", "edited"): "interrupted",
    ("interrupted", "decided"): "interrupted",
    ("interrupted", "resolved"): "idle",
}
ACTION = "struct<action_no:int,initial:map<string,string>,args:map<string,string>,allowed:array<string>,decision:string,message:string>"
STATE = f"struct<status:string,actions:array<{ACTION}>,errors:int,ignored:int,last_error:string>"


def _after(status: Column, kind: Column) -> Column:
    """The status that the table gives, or null."""
    out = F.lit(None).cast("string")
    for (before, what), behind in TRANSITIONS.items():
        out = F.when((status == before) & (kind == what), behind).otherwise(out)
    return out


def _step(s: Column, e: Column) -> Column:
    own = F.filter(s.actions, lambda a: a.action_no == e.action_no)
    known = F.size(own) > 0
    others = F.filter(s.actions, lambda a: a.action_no != e.action_no)
    mine = F.get(own, F.lit(0))
    none = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    brought = F.coalesce(e.args, empty)
    made = lambda initial, args, allowed, chosen, message: F.concat(others, F.array(F.struct(e.action_no.alias("action_no"), initial.alias("initial"), args.alias("args"), allowed.alias("allowed"), chosen.alias("decision"), message.alias("message"))))
    said = decision(mine.allowed, e.choice, e.reason, args_changed(mine.args, mine.initial))
    after = _after(s.status, e.kind)
    heeded = after.isNotNull() & (e.kind.isin("requested", "resolved") | known)
    error = F.when(heeded & (e.kind == "decided"), said.error)
    actions = (
        F.when(~heeded | error.isNotNull() | (e.kind == "resolved"), s.actions)
        .when(e.kind == "requested", made(brought, brought, F.coalesce(e.allowed, F.array().cast("array<string>")), none, none))
        .when(e.kind == "edited", made(mine.initial, edited_args(mine.args, brought), mine.allowed, none, none))
        .otherwise(made(mine.initial, mine.args, mine.allowed, said.type, said.message))
    )
    complete = heeded & (e.kind == "decided") & error.isNull() & F.forall(others, lambda a: a.decision.isNotNull())
    return F.struct(
        F.when(complete, "busy").when(heeded, after).otherwise(s.status).alias("status"),
        actions.alias("actions"),
        (s.errors + error.isNotNull().cast("int")).alias("errors"),
        (s.ignored + (~heeded).cast("int")).alias("ignored"),
        F.coalesce(error, s.last_error).alias("last_error"),
    ).cast(STATE)


def folded(log: DataFrame) -> DataFrame:
    """``request_id, status, complete, decisions, changed, errors, ignored, last_error`` of every request.

    ``decisions`` are those of all actions in their order, null unless the
    request is complete; ``changed`` counts actions with other arguments than
    they were requested with.
    """
    rows = F.collect_list(F.struct("seq", "kind", "action_no", "choice", "reason", "args", "allowed"))
    key = lambda r: F.struct(r.seq, r.kind, r.action_no)
    ordered = F.array_sort(rows, lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))
    start = F.struct(F.lit("none").alias("status"), F.array().alias("actions"), F.lit(0).alias("errors"), F.lit(0).alias("ignored"), F.lit(None).cast("string").alias("last_error")).cast(STATE)
    s = log.groupBy("request_id").agg(F.aggregate(ordered, start, _step).alias("s")).select("request_id", "s.*")
    by_action = F.array_sort(F.transform("actions", lambda a: F.struct(a.action_no.alias("action_no"), a.decision.alias("decision"))))
    complete = F.col("status") == "busy"
    return s.select(
        "request_id", "status", complete.alias("complete"), F.when(complete, F.array_join(F.transform(by_action, lambda a: a.decision), ",")).alias("decisions"),
        F.size(F.filter("actions", lambda a: args_changed(a.args, a.initial))).alias("changed"), "errors", "ignored", "last_error",
    )
