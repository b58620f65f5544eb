"""Queries of the review operators over requests and logs made from ``events``, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import review, review_log
from lodestone.sources.articles import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review logs of three actions; about eight events of a user make a request."""
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "requested").when(F.col("event_type") == "view", "edited").when((F.col("event_type") == "error") & (n % 4 == 0), "resolved").otherwise("decided")
    action = (F.floor(F.col("value")) % 3).cast("int")
    choice = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "purchase", "reject").otherwise("edit")
    allowed = F.when(action == 0, F.array(*map(F.lit, ("approve", "edit", "reject")))).when(action == 1, F.array(F.lit("reject"), F.lit("edit"))).otherwise(F.array(F.lit("approve")))
    args = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("fixed"), F.lit("1"))
    edits = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100_000 + F.floor(n / 1500)).alias("request_id"), n.alias("seq"), kind.alias("kind"), action.alias("action_no"), choice.alias("choice"),
        F.when(n % 2 == 0, F.concat(F.lit(" no "), F.col("user_id").cast("string"))).otherwise("  ").alias("reason"), F.when(kind == "requested", args).when(kind == "edited", edits).alias("args"), F.when(kind == "requested", allowed).alias("allowed"),
    )


# the same fold, one row after the other, with a column for each of the three actions
_WALK = """
WITH RECURSIVE log AS (
  SELECT user_id * 100000 + CAST(floor(event_id / 1500) AS BIGINT) AS request_id, event_id,
    CASE WHEN event_type = 'signup' THEN 'requested' WHEN event_type = 'view' THEN 'edited' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'resolved' ELSE 'decided' END AS kind,
    CAST(floor(value) AS BIGINT) % 3 + 1 AS a, CASE event_type WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'reject' ELSE 'edit' END AS choice, event_id % 2 = 0 AS reasoned, props ->> '$.k' AS k FROM events
), numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY event_id) AS step FROM log),
-- what each row would do, given what is known of its action: was it requested, and with other arguments
walk AS (
  SELECT DISTINCT request_id, 0::BIGINT AS step, 'none' AS status, CAST([NULL, NULL, NULL] AS VARCHAR[]) AS initial, CAST([NULL, NULL, NULL] AS VARCHAR[]) AS args, CAST([NULL, NULL, NULL] AS VARCHAR[]) AS made, 0 AS errors, 0 AS ignored, CAST(NULL AS VARCHAR) AS last_error FROM log
  UNION ALL
  SELECT request_id, step, CASE WHEN done AND len(list_filter([1, 2, 3], lambda i: initial[i] IS NOT NULL AND made[i] IS NULL)) = 0 THEN 'busy' WHEN heeded AND kind = 'resolved' THEN 'idle' WHEN heeded THEN 'interrupted' ELSE status END,
    initial, args, made, errors + CAST(error IS NOT NULL AS INTEGER), ignored + CAST(NOT heeded AS INTEGER), coalesce(error, last_error)
  FROM (
    SELECT request_id, step, status, kind, heeded, error, errors, ignored, last_error, heeded AND kind = 'decided' AND error IS NULL AS done,
      [CASE WHEN heeded AND kind = 'requested' AND a = i THEN k ELSE initial[i] END FOR i IN [1, 2, 3]] AS initial,
      [CASE WHEN heeded AND kind IN ('requested', 'edited') AND a = i THEN k ELSE args[i] END FOR i IN [1, 2, 3]] AS args,
      [CASE WHEN a <> i OR NOT heeded OR kind = 'resolved' OR error IS NOT NULL THEN made[i] WHEN kind IN ('requested', 'edited') THEN NULL
        WHEN choice = 'edit' AND a = 1 AND NOT changed THEN 'approve' ELSE choice END FOR i IN [1, 2, 3]] AS made
    FROM (
      SELECT *, CASE WHEN heeded AND kind = 'decided' THEN CASE WHEN NOT list_contains(CASE a WHEN 1 THEN ['approve', 'edit', 'reject'] WHEN 2 THEN ['reject', 'edit'] ELSE ['approve'] END, choice) THEN 'No response selected.'
        WHEN choice = 'reject' AND NOT reasoned THEN 'Please provide a rejection reason.' END END AS error
      FROM (
        SELECT w.request_id, n.step, w.status, w.initial, w.args, w.made, w.errors, w.ignored, w.last_error, n.kind, n.a, n.choice, n.reasoned, n.k, w.args[n.a] IS DISTINCT FROM w.initial[n.a] AS changed,
          CASE w.status WHEN 'none' THEN n.kind = 'requested' WHEN 'interrupted' THEN n.kind IN ('requested', 'resolved') OR w.initial[n.a] IS NOT NULL ELSE false END AS heeded
        FROM walk w JOIN numbered n ON n.request_id = w.request_id AND n.step = w.step + 1)))
)
"""


@query(_WALK + """
SELECT request_id, status, status = 'busy' AS complete, CASE WHEN status = 'busy' THEN array_to_string(list_filter(made, lambda x: x IS NOT NULL), ',') END AS decisions,
  CAST(len(list_filter([1, 2, 3], lambda i: args[i] IS DISTINCT FROM initial[i])) AS INTEGER) AS changed, errors, ignored, last_error
FROM walk QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY step DESC) = 1""")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every request stands after its log."""
    return review_log.folded(_log(spark, sf_dir))


# requests of two actions as JSON; some are broken, some come as arrays
_ALLOWED = ("approve", "edit", "reject")
_ONE = """CASE event_id % 9
    WHEN 0 THEN 'no json ' || props WHEN 1 THEN NULL
    ELSE '{"action_requests":[' || CASE event_id % 9 WHEN 2 THEN '' ELSE '{"name":"' || event_type || '"' || CASE event_id % 9 WHEN 3 THEN '' ELSE ',"args":' || props END || '}' END
      || '],"review_configs":[' || CASE event_id % 9 WHEN 4 THEN '' ELSE '{' || CASE event_id % 9 WHEN 5 THEN '' ELSE '"action_name":"' || CASE WHEN event_id % 4 = 0 THEN 'other' ELSE event_type END || '",' END
      || '"allowed_decisions":[' || concat_ws(',', CASE WHEN event_id % 2 = 0 THEN '"reject"' END, CASE WHEN event_id % 5 = 0 THEN '"unknown"' END, CASE WHEN event_id % 3 = 0 THEN '"edit"' END, CASE WHEN user_id % 2 = 0 THEN '"approve"' END)
      || ']},{"action_name":"view","allowed_decisions":["approve"]}' END || ']}' END"""
_SEVERAL = "CASE event_id % 9 WHEN 7 THEN '[' || one || ', {}]' WHEN 8 THEN '[{}, ' || one || ']' ELSE one END"
_TEXT = f"SELECT event_id, {_SEVERAL} AS j, event_type AS name FROM (SELECT event_id, event_type, {_ONE} AS one FROM events)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, j, name``: one request an event, and the name of its action."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS name", f"{_ONE} AS one").selectExpr("event_id", f"{_SEVERAL} AS j", "name")


_FIRST = f"""t AS ({_TEXT}), first AS (SELECT event_id, name, CASE WHEN j IS NOT NULL AND json_valid(j) THEN CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[0]') ELSE json(j) END END AS r FROM t),
 parts AS (SELECT event_id, name, CAST(json_extract(r, '$.action_requests[*]') AS JSON[]) AS actions, CAST(json_extract(r, '$.review_configs[*]') AS JSON[]) AS configs FROM first),
 judged AS (SELECT *, coalesce(len(actions) > 0 AND len(configs) > 0 AND len(list_filter(actions, lambda a: json_extract(a, '$.name') IS NULL OR json_extract(a, '$.args') IS NULL)) = 0
   AND len(list_filter(configs, lambda c: json_extract(c, '$.action_name') IS NULL OR json_extract(c, '$.allowed_decisions') IS NULL)) = 0, false) AS valid FROM parts),
 matched AS (SELECT *, coalesce(list_filter(configs, lambda c: c ->> '$.action_name' = name)[1], configs[1]) AS config FROM judged WHERE valid),
 named AS (SELECT event_id, name, configs, CAST(json_extract_string(config, '$.allowed_decisions[*]') AS VARCHAR[]) AS allowed FROM matched)"""


@query(f"WITH {_FIRST} SELECT event_id, valid FROM judged")
def hitl_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("event_id", review.valid_request(F.col("j")).alias("valid"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, name, configs, allowed`` of the valid requests; ``allowed`` is that of the action's config."""
    rows = _requests(spark, sf_dir).where(review.valid_request(F.col("j"))).select("event_id", "name", review.first_request(F.col("j")).review_configs.alias("configs"))
    return rows.withColumn("allowed", review.config_for(F.col("name"), F.col("configs"), F.lit(0)).allowed_decisions)


@query(f"WITH {_FIRST} SELECT event_id, name, array_to_string(allowed, ',') AS allowed FROM named")
def review_config_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name, else the first config."""
    return _parsed(spark, sf_dir).select("event_id", "name", F.array_join("allowed", ",").alias("allowed"))


@query(f"""WITH {_FIRST} SELECT event_id, array_to_string(list_filter(['edit', 'approve', 'reject'], lambda d: list_contains(allowed, d)), ',') AS offered,
  list_filter(['approve', 'reject', 'edit'], lambda d: list_contains(allowed, d))[1] AS chosen, len(list_filter(['edit', 'approve', 'reject'], lambda d: list_contains(allowed, d))) > 1 AS several FROM named""")
def review_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = review.offered(F.col("allowed"))
    return _parsed(spark, sf_dir).select("event_id", F.array_join(own, ",").alias("offered"), review.default_choice(F.col("allowed")).alias("chosen"), (F.size(own) > 1).alias("several"))


@query(f"WITH {_FIRST} SELECT event_id, len(list_filter(configs, lambda c: NOT list_contains(CAST(json_extract_string(c, '$.allowed_decisions[*]') AS VARCHAR[]), 'approve'))) = 0 AS every FROM named")
def all_allow_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("event_id", review.all_allow_approve(F.col("configs")).alias("every"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action that a log requests with the decision that comes next to it."""
    n = F.col("event_id")
    parsed = _parsed(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type", "props", "user_id"), "event_id")
    selected = F.when(n % 4 == 1, "approve").when(n % 4 == 2, "reject").when(n % 4 == 3, "edit")
    reason = F.when(n % 8 == 2, " ").when(n % 8 == 6, F.concat(F.lit(" "), "event_type", F.lit("\n")))
    initial = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    edits = F.when(n % 3 == 0, F.create_map(F.lit("k"), F.col("user_id").cast("string"))).when(n % 3 == 1, F.create_map(F.lit("new"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    return parsed.select("event_id", "allowed", selected.alias("selected"), reason.alias("reason"), initial.alias("initial"), review.edited_args(initial, edits).alias("args"))


_EDITED = "event_id % 3 = 1 OR event_id % 3 = 0 AND CAST(user_id AS VARCHAR) <> props ->> '$.k'"


@query(f"""WITH {_FIRST}, d AS (SELECT event_id, list_filter(['edit', 'approve', 'reject'], lambda x: list_contains(allowed, x)) AS offered, [NULL, 'approve', 'reject', 'edit'][event_id % 4 + 1] AS selected,
  CASE event_id % 8 WHEN 6 THEN event_type ELSE '' END AS reason, {_EDITED} AS edited FROM named JOIN events USING (event_id)), e AS (
  SELECT *, CASE WHEN len(offered) = 0 THEN 'Please enter a response.' WHEN selected IS NULL OR NOT list_contains(offered, selected) THEN 'No response selected.' WHEN selected = 'reject' AND reason = '' THEN 'Please provide a rejection reason.' END AS error FROM d)
SELECT event_id, CASE WHEN error IS NULL THEN CASE WHEN selected = 'edit' AND list_contains(offered, 'approve') AND NOT edited THEN 'approve' ELSE selected END END AS type,
  CASE WHEN error IS NULL AND selected = 'reject' THEN reason END AS message, error FROM e""")
def review_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = review.decision(F.col("allowed"), F.col("selected"), F.col("reason"), review.args_changed(F.col("args"), F.col("initial")))
    return _decided(spark, sf_dir).select("event_id", made.alias("d")).select("event_id", "d.type", "d.message", "d.error")


@query(f"WITH {_FIRST} SELECT event_id, coalesce({_EDITED}, false) AS changed, 'k=' || CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE props ->> '$.k' END || CASE WHEN event_id % 3 = 1 THEN ',new=1' ELSE '' END AS args FROM named JOIN events USING (event_id)")
def args_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments after an edit, and whether they are others than before."""
    entries = F.array_sort(F.map_entries("args"))
    return _decided(spark, sf_dir).select("event_id", review.args_changed(F.col("args"), F.col("initial")).alias("changed"), F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("args"))


@query("""SELECT event_id, CAST(1 + CAST(event_type <> 'view' AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER) AS INTEGER) AS n, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'Interrupt ' || event_id END AS title FROM events""")
def interrupt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupts without the missing ones, with their titles."""
    n = F.col("event_id")
    values = F.array(F.col("props"), F.when(F.col("event_type") != "view", F.col("event_type")), F.when(n % 3 == 0, F.lit("x")))
    title = F.when(n % 2 == 0, F.col("event_type")).when(n % 4 == 1, "")
    return table(spark, sf_dir, "events").select("event_id", F.size(review.normalised_interrupts(values)).alias("n"), review.interrupt_title(title, n).alias("title"))
