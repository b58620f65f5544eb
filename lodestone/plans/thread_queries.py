"""Queries of conversation, upload, review and helper operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import checkpoints, prompts, threads, uploads
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


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages: user is human, assistant is ai."""
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    own = table(spark, sf_dir, "conversations")
    return own.select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), kind.alias("type"), F.col("text").alias("content"))


_ROWS = "(SELECT conv_id, turn, conv_id || '-' || turn AS id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type, text AS content FROM conversations)"


@query(f"SELECT conv_id, coalesce(CASE WHEN bool_or(type = 'human') THEN arg_max(content, turn) FILTER (WHERE type = 'human') END, arg_max(content, turn), '') AS text FROM {_ROWS} GROUP BY conv_id")
def last_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.last_user_text(_rows(spark, sf_dir))


@query(f"""
SELECT conv_id, turn, id, type, CASE WHEN turn = 0 THEN 'edited' ELSE content END AS content FROM {_ROWS}
UNION ALL SELECT conv_id, max(turn) + 1, conv_id || '-new', 'ai', 'the answer' FROM {_ROWS} GROUP BY conv_id
""")
def conversation_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation gets an answer, and its first message a new text."""
    rows = _rows(spark, sf_dir)
    new = rows.select("conv_id").distinct().select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit("-new")).alias("id"), F.lit("ai").alias("type"), F.lit("the answer").alias("content"))
    edited = rows.where("turn = 0").select("conv_id", "id", "type", F.lit("edited").alias("content"))
    return threads.append(rows, new.unionByName(edited))


def _tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which half the AI ones have two tool calls; in every fourth conversation what users say counts as tool results."""
    rows = _rows(spark, sf_dir)
    kind = F.when((F.col("type") == "human") & (F.col("conv_id") % 4 == 0), "tool").otherwise(F.col("type"))
    call = lambda i, name: F.struct(i.alias("id"), F.lit(name).alias("name"), F.create_map().cast("map<string,string>").alias("args"))
    calls = F.array(call(F.concat("id", F.lit("-x")), "f"), call(F.lit(None).cast("string"), "g"))
    some = (F.col("type") == "ai") & ((F.col("conv_id") + F.col("turn")) % 2 == 0)
    return rows.select("conv_id", "turn", kind.alias("type"), F.when(some, calls).otherwise(F.slice(calls, 1, 0)).alias("tool_calls"))


_TOOLS = f"""(SELECT *, lead(type) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM (SELECT conv_id, turn, id, CASE WHEN type = 'human' AND conv_id % 4 = 0 THEN 'tool' ELSE type END AS type FROM {_ROWS}))"""
_REPLIES = f"""SELECT conv_id, turn, call_no, 'do-not-render-' || md5(conv_id || '|' || turn || '|' || call_no) AS id, CASE call_no WHEN 0 THEN id || '-x' ELSE '' END AS tool_call_id,
  CASE call_no WHEN 0 THEN 'f' ELSE 'g' END AS name, 'Successfully handled tool call.' AS content
FROM {_TOOLS}, (VALUES (0), (1)) c(call_no) WHERE type = 'ai' AND (conv_id + turn) % 2 = 0 AND after IS DISTINCT FROM 'tool'"""


@query(_REPLIES)
def missing_tool_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.missing_tool_replies(_tool_rows(spark, sf_dir))


@query(f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY last, turn, call_no)::INTEGER AS place, type, id, content FROM (
  SELECT conv_id, 0 AS last, turn, call_no, 'tool' AS type, id, content FROM ({_REPLIES}) WHERE conv_id % 3 <> 0
  UNION ALL SELECT DISTINCT conv_id, 1, 0, 0, 'human', 'new-' || conv_id, 'typed for ' || conv_id FROM conversations WHERE conv_id % 3 <> 0)
""")
def submit_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing tool replies come before the human message; nothing goes to a conversation without one."""
    own = F.col("conv_id").cast("string")
    typed = table(spark, sf_dir, "conversations").where("conv_id % 3 <> 0").select("conv_id").distinct().select("conv_id", F.concat(F.lit("new-"), own).alias("id"), F.concat(F.lit("typed for "), own).alias("content"))
    return threads.submission(_tool_rows(spark, sf_dir), typed)


@query(f"SELECT conv_id, turn, id, type FROM {_ROWS} WHERE id NOT LIKE 'do-not-render-%'")
def visible_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("conv_id", "turn", "id", "type")
    hidden = rows.withColumn("id", F.concat(F.lit(threads.HIDDEN), "id"))
    return threads.visible(rows.unionByName(hidden))


@query(f"SELECT conv_id, arg_min(content, turn) AS title FROM {_ROWS} GROUP BY conv_id UNION ALL SELECT -5, '-5'")
def thread_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All threads and one without messages."""
    rows = _rows(spark, sf_dir)
    return threads.titles(rows.select("conv_id").distinct().unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("conv_id"))), rows)


@query(f"SELECT conv_id FROM {_ROWS} GROUP BY conv_id HAVING NOT bool_or(type IN ('ai', 'tool'))")
def threads_without_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.without_reply(_rows(spark, sf_dir))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as checkpoints, one a turn; in every fifth the second turn was edited and answered, which is a second branch."""
    rows = _rows(spark, sf_dir)
    key = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    nodes = rows.select("conv_id", key(F.col("turn")).alias("checkpoint_id"), key(before).alias("parent_id"), "id", "type", "content")
    second = rows.where("conv_id % 5 = 0 AND turn = 1")
    edits = second.select("conv_id", F.lit("c1").alias("asked"), F.lit("c1e").alias("checkpoint_id"), F.concat("id", F.lit("-edited")).alias("id"), F.concat(F.lit("edited: "), "content").alias("content"))
    replies = second.select("conv_id", F.lit("c1r").alias("checkpoint_id"), F.lit("c1e").alias("parent_id"), F.concat("id", F.lit("-reply")).alias("id"), F.lit("ai").alias("type"), F.lit("a reply").alias("content"))
    return checkpoints.edited(nodes, edits).unionByName(replies)


_FOREST = f"""nodes AS (
  SELECT conv_id, 'c' || turn AS checkpoint_id, 'c' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, id, type, content FROM {_ROWS}
  UNION ALL SELECT conv_id, 'c1e', 'c' || (SELECT max(turn) FROM conversations o WHERE o.conv_id = m.conv_id AND o.turn < 1), id || '-edited', type, 'edited: ' || content FROM {_ROWS} m WHERE conv_id % 5 = 0 AND turn = 1
  UNION ALL SELECT conv_id, 'c1r', 'c1e', id || '-reply', 'ai', 'a reply' FROM {_ROWS} WHERE conv_id % 5 = 0 AND turn = 1
), walk AS (
  SELECT conv_id, checkpoint_id AS leaf, checkpoint_id, parent_id, id, type, content, 0 AS height FROM nodes
  UNION ALL SELECT w.conv_id, w.leaf, n.checkpoint_id, n.parent_id, n.id, n.type, n.content, w.height + 1 FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.checkpoint_id = w.parent_id
), placed AS (SELECT *, max(height) OVER (PARTITION BY conv_id, leaf) - height AS place FROM walk),
ends AS (SELECT conv_id, checkpoint_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.conv_id = n.conv_id AND c.parent_id = n.checkpoint_id))
"""


@query(f"WITH RECURSIVE {_FOREST} SELECT p.conv_id, leaf, CAST(place AS BIGINT) AS place, p.checkpoint_id, id, type, content FROM placed p JOIN ends e ON e.conv_id = p.conv_id AND e.checkpoint_id = p.leaf")
def branch_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every branch, from the root to its leaf."""
    nodes = _forest(spark, sf_dir)
    return checkpoints.states(nodes, checkpoints.leaves(nodes))


@query(f"""WITH RECURSIVE {_FOREST} SELECT n.conv_id, n.checkpoint_id AS asked, CAST(place AS BIGINT) AS place, p.checkpoint_id, p.id
  FROM nodes n JOIN ends e ON e.conv_id = n.conv_id AND e.checkpoint_id = n.checkpoint_id JOIN placed p ON p.conv_id = n.conv_id AND p.leaf = n.parent_id""")
def regenerate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last message of every branch is made from anew: the state of its parent checkpoint."""
    nodes = _forest(spark, sf_dir)
    return checkpoints.before(nodes, checkpoints.leaves(nodes)).select("conv_id", "asked", "place", "checkpoint_id", "id")


@query(f"""WITH RECURSIVE {_FOREST}, asked AS (SELECT * FROM nodes WHERE type = 'human' AND parent_id IS NOT NULL)
SELECT a.conv_id, a.checkpoint_id || '-again' AS leaf, CAST(place AS BIGINT) AS place, p.id, p.content FROM asked a JOIN placed p ON p.conv_id = a.conv_id AND p.leaf = a.parent_id
UNION ALL SELECT a.conv_id, a.checkpoint_id || '-again', CAST(max(p.place) + 1 AS BIGINT), a.id || '-again', 'again: ' || a.content FROM asked a JOIN placed p ON p.conv_id = a.conv_id AND p.leaf = a.parent_id GROUP BY ALL""")
def edit_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every human message but a first one is edited; the branches that begin with the new texts."""
    nodes = _forest(spark, sf_dir)
    asked = nodes.where("type = 'human' AND parent_id IS NOT NULL")
    new = lambda c: F.concat(c, F.lit("-again"))
    edits = asked.select("conv_id", F.col("checkpoint_id").alias("asked"), new("checkpoint_id").alias("checkpoint_id"), new("id").alias("id"), F.concat(F.lit("again: "), "content").alias("content"))
    return checkpoints.states(checkpoints.edited(nodes, edits), edits).select("conv_id", "leaf", "place", "id", "content")


@query(f"SELECT id, 'ui-' || id AS ui_id, conv_id FROM {_ROWS} WHERE type = 'ai'")
def message_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    ui = rows.where("type = 'ai'").select(F.col("id").alias("message_id"), F.concat(F.lit("ui-"), "id").alias("ui_id"))
    return threads.artifacts(rows, ui).select("id", "ui_id", "conv_id")


@query(f"""WITH RECURSIVE {_FOREST} SELECT conv_id, checkpoint_id, CAST(row_number() OVER w AS INTEGER) AS position, count(*) OVER (PARTITION BY conv_id, parent_id) AS branches,
  lag(checkpoint_id) OVER w AS previous, lead(checkpoint_id) OVER w AS next FROM nodes WINDOW w AS (PARTITION BY conv_id, parent_id ORDER BY checkpoint_id)""")
def branch_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.branches(_forest(spark, sf_dir))


@query(f"SELECT conv_id, turn, content AS message FROM (SELECT *, lag(type) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM {_ROWS}) WHERE type IS DISTINCT FROM p".replace("content AS message", "type AS message"))
def error_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types stand in for error messages."""
    return threads.changed_errors(_rows(spark, sf_dir).select("conv_id", "turn", F.col("type").alias("message")))


@query(f"SELECT conv_id, turn AS step, turn + 1 AS n, type AS last_type FROM {_ROWS} WHERE type = 'ai'")
def first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a state with one more message."""
    return threads.first_tokens(_rows(spark, sf_dir).select("conv_id", F.col("turn").alias("step"), (F.col("turn") + 1).alias("n"), F.col("type").alias("last_type")))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system' AND text <> '') AS system FROM conversations GROUP BY conv_id")
def system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir)
    return rows.select("conv_id", prompts.system_prompt(F.col("m")).alias("system"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    return own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m.role.alias("role"), m.text.alias("content"))).alias("m"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def llm_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _messages(spark, sf_dir).select("conv_id", prompts.turns(F.col("m")).alias("t")).where(F.size("t") > 0)
    return own.select("conv_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.transform("t", lambda m: F.concat(m.role, F.lit(":"), m.content)), "|")).alias("digest"))


@query(f"SELECT conv_id, turn, CASE type WHEN 'human' THEN 'User' WHEN 'ai' THEN 'Assistant' WHEN 'tool' THEN 'Tool' WHEN 'System' THEN 'System' ELSE '' END AS label FROM {_ROWS}")
def role_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("conv_id", "turn", prompts.role_label(F.col("type")).alias("label"))


@query(f"SELECT conv_id, turn, type || ': ' || content || CASE WHEN type = 'ai' THEN ' - Tool calls: []' ELSE '' END AS line FROM {_ROWS}")
def message_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.when(F.col("type") == "ai", "[]")
    return _rows(spark, sf_dir).select("conv_id", "turn", prompts.message_line(F.col("type"), F.col("content"), calls).alias("line"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as the blocks of one message; every third is an image, every fifth conversation has none."""
    block = F.struct("turn", F.when(F.col("turn") % 3 == 1, "image").otherwise("text").alias("type"), "text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: b.dropFields("turn")).alias("blocks"))
    return rows.select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.slice("blocks", 1, 0)).otherwise(F.col("blocks")).alias("blocks"))


_TEXTS = "FILTER (WHERE turn % 3 <> 1 AND conv_id % 5 <> 0)"


@query(f"SELECT conv_id, md5(CASE WHEN conv_id % 7 = 3 THEN ' plain  text ' || conv_id ELSE coalesce(string_agg(text, ' ' ORDER BY turn) {_TEXTS}, '') END) AS content_md5 FROM conversations GROUP BY conv_id")
def content_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, or for some messages plain text."""
    plain = F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit(" plain  text "), F.col("conv_id").cast("string")))
    return _blocks(spark, sf_dir).select("conv_id", F.md5(prompts.content_string(plain, F.col("blocks"))).alias("content_md5"))


@query(f"SELECT conv_id, md5(regexp_replace(coalesce(string_agg(text, '' ORDER BY turn) {_TEXTS}, ''), '^\\s+|\\s+$', '', 'g')) AS response_md5 FROM conversations GROUP BY conv_id")
def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("conv_id", F.md5(text.strip(prompts.joined_text_blocks(F.col("blocks"), ""))).alias("response_md5"))


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN CASE WHEN conv_id % 5 = 0 THEN 'text' ELSE 'text,' || string_agg(CASE WHEN turn % 3 = 1 THEN 'image' ELSE 'text' END, ',' ORDER BY turn) END
  WHEN conv_id % 5 <> 0 THEN string_agg(CASE WHEN turn % 3 = 1 THEN 'image' ELSE 'text' END, ',' ORDER BY turn) END AS sent FROM conversations GROUP BY conv_id""")
def outgoing_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of the blocks that a message sends; the typed text is blank for every second one."""
    rows = _blocks(spark, sf_dir).withColumn("typed", F.when(F.col("conv_id") % 2 == 1, "hello").otherwise(" \n "))
    sent = threads.outgoing(F.col("typed"), F.col("blocks"))
    return rows.select("conv_id", F.array_join(F.transform(sent, lambda b: b.type), ",").alias("sent"))


@query("""SELECT conv_id, CASE WHEN conv_id % 6 <> 0 THEN coalesce(string_agg(turn, ',' ORDER BY turn) FILTER (WHERE role = 'system'), string_agg(turn, ',' ORDER BY turn) FILTER (WHERE role = 'assistant' AND conv_id % 2 = 0),
  string_agg(turn, ',' ORDER BY turn) FILTER (WHERE role = 'user')) END AS shown FROM conversations GROUP BY conv_id""")
def tool_call_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role stand for calls with arguments, streamed ones and bare ones; some conversations hide them."""
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("turn"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("system").alias("a"), of("assistant").alias("b"), of("user").alias("c"))
    streamed = F.when(F.col("conv_id") % 2 == 0, F.col("b"))
    shown = threads.tool_calls_shown(F.col("a"), streamed, F.col("c"), F.col("conv_id") % 6 == 0)
    return rows.select("conv_id", F.array_join(shown.cast("array<string>"), ",").alias("shown"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tool call whose arguments come in fragments of nine characters and break off after a number of characters that follows from the id.

    Some have no id, an empty one or no name; some are text, some have brackets that don't match.
    """
    own = table(spark, sf_dir, "events")
    n = F.col("event_id")
    args = F.concat(F.lit('{"event": '), n.cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('\\n\\"q\\"", "props": '), F.col("props"), F.lit(', "tags": ["'), F.col("event_type"), F.lit('", '), F.col("user_id").cast("string"), F.lit("]}"))
    args = F.when(n % 13 == 0, F.concat(F.lit("[}"), args)).otherwise(args)
    whole = own.select(
        (n % 1000).alias("conv_id"), n.alias("block_no"), F.when(n % 5 == 0, "text").otherwise("tool_use").alias("type"), F.when(n % 7 == 0, "").when(n % 11 != 0, F.concat(F.lit("call-"), n.cast("string"))).alias("id"),
        F.when(n % 3 != 0, F.col("event_type")).alias("name"), F.substring(args, F.lit(1), (n % (F.length(args) + 1)).cast("int")).alias("input"),
    )
    parts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("input") - 1) / 9).cast("int"), F.lit(0)))
    rows = whole.select("*", F.explode(parts).alias("fragment_no"))
    later = F.col("fragment_no") > 0  # id, type and name come with the first fragment alone
    return rows.select("conv_id", "block_no", "fragment_no", *(F.when(~later, F.col(c)).alias(c) for c in ("type", "id", "name")), F.substring("input", F.col("fragment_no") * 9 + 1, F.lit(9)).alias("input"))


@query("""
WITH called AS (
  SELECT event_id, event_type, CASE WHEN event_id % 13 = 0 THEN '[}' ELSE '' END || '{"event": ' || event_id || ', "kind": "' || event_type || '\\n\\"q\\"", "props": ' || props || ', "tags": ["' || event_type || '", ' || user_id || ']}' AS args
  FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0
), cut AS (SELECT *, substr(args, 1, CAST(event_id % (length(args) + 1) AS INTEGER)) AS part FROM called)
-- at most one of these ends a text rightly; a comma at the end, which DuckDB lets pass, none does
SELECT event_id % 1000 AS conv_id, 'call-' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS name,
  coalesce(list_filter(list_transform(['', '}', ']', '"}', '}}', '"}}', ']}', '"]}'], lambda s: CASE WHEN json_valid(part || s) AND rtrim(part) NOT LIKE '%,' THEN CAST(json(part || s) AS VARCHAR) END), lambda x: x IS NOT NULL)[1], '{}') AS args
FROM cut
""")
def tool_use_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = threads.assembled(_streamed(spark, sf_dir))
    return whole.select("conv_id", F.explode(threads.tool_use_blocks(F.col("blocks"))).alias("c")).select("conv_id", "c.id", "c.name", "c.args")


_NAMED = "SELECT page_id, 'f' || page_id // 4 || '.x' AS name, ['image/png', 'image/jpeg', 'application/pdf', 'text/plain', NULL][CASE WHEN page_id % 2 = 0 THEN page_id // 4 ELSE page_id END % 5 + 1] AS mime_type, page_id % 3 = 0 AS attached FROM pages"


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names and types made of pages: the files of a drop, and what is attached already."""
    k, four = F.col("page_id"), F.floor(F.col("page_id") / 4)
    types = F.array(*map(F.lit, ("image/png", "image/jpeg", "application/pdf", "text/plain")))
    own = table(spark, sf_dir, "pages").select(k, F.concat(F.lit("f"), four.cast("string"), F.lit(".x")).alias("name"), F.get(types, (F.when(k % 2 == 0, four).otherwise(k) % 5).cast("int")).alias("mime_type"))
    return own.where("page_id % 3 <> 0"), own.where("page_id % 3 = 0").select("name", "mime_type")


_ALLOWED = "mime_type IN ('image/png', 'image/jpeg', 'application/pdf')"


@query(f"SELECT page_id, coalesce({_ALLOWED}, false) AS allowed FROM ({_NAMED}) WHERE NOT attached")
def upload_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)[0].select("page_id", uploads.allowed(F.col("mime_type")).alias("allowed"))


@query(f"WITH n AS ({_NAMED}) SELECT page_id, name, mime_type FROM n f WHERE NOT attached AND {_ALLOWED} AND EXISTS (SELECT 1 FROM n o WHERE o.attached AND o.name = f.name AND o.mime_type = f.mime_type)")
def upload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.duplicates(*_files(spark, sf_dir))


@query(f"WITH n AS ({_NAMED}) SELECT page_id, name, mime_type FROM n f WHERE NOT attached AND {_ALLOWED} AND NOT EXISTS (SELECT 1 FROM n o WHERE o.attached AND o.name = f.name AND o.mime_type = f.mime_type)")
def upload_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.unique(*_files(spark, sf_dir))


@query("""SELECT page_id, page_id % 5 IN (0, 1) AND page_id % 3 < 2 OR page_id % 5 = 2 AND page_id % 3 = 1 AS media FROM pages""")
def is_media_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three kinds with the types of files: images as either kind, a PDF as a file alone."""
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "image").when(k % 3 == 1, "file").otherwise("text")
    types = F.array(*map(F.lit, ("image/png", "image/jpeg", "application/pdf", "text/plain")))
    return table(spark, sf_dir, "pages").select(k, uploads.is_media(kind, F.get(types, (k % 5).cast("int"))).alias("media"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 2 = 0 THEN 'name of ' || page_id ELSE 'PDF file' END AS label, md5('data:application/pdf;base64,' || base64(encode(html))) AS url_md5,
  base64(encode(html)) = split_part('data:application/pdf;base64,' || base64(encode(html)), ',', 2) AS back FROM pages""")
def block_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF's label by file name, name or neither, and its data URL, whose payload comes back."""
    k = F.col("page_id")
    label = uploads.file_label(F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, ""), F.when(k % 2 == 0, F.concat(F.lit("name of "), k.cast("string"))).when(k % 4 == 1, ""))
    data = text.base64_text(F.col("html").cast("binary"))
    url = uploads.data_url(F.lit("application/pdf"), data)
    return table(spark, sf_dir, "pages").select(k, label.alias("label"), F.md5(url).alias("url_md5"), (text.data_url_payload(url) == data).alias("back"))


@query("SELECT event_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(event_type, '[_-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM events")
def prettify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.prettify(F.col("event_type")).alias("label"))


@query("SELECT event_id, strftime(ts, '%m/%d/%Y %I:%M %p') AS shown FROM events")
def pretty_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.pretty_date(F.col("ts").cast("string")).alias("shown"))


@query("SELECT event_id, props AS props_cell, strftime(ts, '%m/%d/%Y %I:%M %p') AS ts_cell FROM events")
def tool_arg_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.cell(F.col("props")).alias("props_cell"), text.cell(F.col("ts").cast("string")).alias("ts_cell"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^\\s/?#]+') AS is_url FROM pages")
def url_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.is_url(F.col("url")).alias("is_url"))


@query("SELECT page_id, 'https://studio.invalid/thread/' || page_id || '?baseUrl=' || replace(url_encode(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')), '~', '%7E') AS u FROM pages")
def studio_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", text.studio_url("https://studio.invalid/thread", own, F.col("page_id").cast("string")).alias("u"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' WHEN len(string_split(text, chr(10))) > 4
  THEN array_to_string(string_split(text, chr(10))[1:4], chr(10)) || chr(10) || '...' ELSE text END AS shown FROM documents""")
def collapse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.col("text")).alias("shown"))


@query("SELECT event_id, 'k' AS key, props ->> '$.k' AS value FROM events WHERE props ->> '$.k' IS NOT NULL")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object as rows; what is no object gives none."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.where("value IS NOT NULL")


#: A JSON value, or another text, of each event: an object, an array of seven, plain text, a number, strings, an empty array, nothing.
_VALUE = """CASE event_id % 8
  WHEN 0 THEN '{"k":' || user_id || ',"kind":"' || event_type || '","more":{"c":[' || event_id || ']},"none":null,"tall":"' || repeat(event_type, 110) || '"}'
  WHEN 1 THEN '["' || event_type || '",' || user_id || ',{"q":' || event_id || '},[4],true,6,7]' WHEN 2 THEN event_type || ' of ' || user_id WHEN 3 THEN CAST(event_id AS STRING)
  WHEN 4 THEN '"' || repeat(event_type, 30) || '"' WHEN 5 THEN '"https://h/' || repeat(event_type, 30) || '"' WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN '[]' ELSE props END END"""
_VALUES = f"(SELECT event_id, {_VALUE} AS j, event_id % 8 IN (0, 1) OR event_id % 8 = 6 AS complex FROM events)"
_SHOWN = "CASE json_type(value) WHEN 'VARCHAR' THEN value ->> '$' WHEN 'NULL' THEN NULL ELSE replace(CAST(value AS VARCHAR), ' ', '') END"
# the items of an array by number, the entries of an object by name
_PARTS = f"""SELECT event_id, j, CAST(i AS VARCHAR) AS key, i, json_extract(j, '$[' || i || ']') AS value FROM (SELECT * FROM {_VALUES} WHERE complex AND j LIKE '[%'), range(0, 5) r(i) WHERE i < json_array_length(j)
  UNION ALL SELECT event_id, j, key, NULL, json_extract(j, '$.' || key) FROM (SELECT event_id, j, unnest(json_keys(j)) AS key FROM {_VALUES} WHERE complex AND j LIKE '{{%')"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_VALUE} AS j")


@query(f"SELECT event_id, key, {_SHOWN} AS value FROM ({_PARTS}) UNION ALL SELECT event_id, NULL, j FROM {_VALUES} WHERE complex IS NOT TRUE")
def tool_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an object, the first five items of an array, any other text as it is."""
    return _values(spark, sf_dir).select("event_id", F.explode(text.result_rows(F.col("j"))).alias("r")).select("event_id", "r.key", "r.value")


@query(f"SELECT event_id, coalesce(complex, false) AS is_complex, CASE WHEN event_id % 8 IN (4, 5) THEN substr(j, 2, length(j) - 2) ELSE j END AS as_text FROM {_VALUES}")
def complex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("event_id", text.is_complex(F.col("j")).alias("is_complex"), text.scalar_text(F.col("j")).alias("as_text"))


_CUT = "CASE WHEN length(x) > 100 AND NOT regexp_matches(x, '^https?://') THEN substr(x, 1, 100) || '...' ELSE x END"


@query(f"""SELECT event_id, CASE WHEN j LIKE '[%' THEN CASE WHEN json_array_length(j) > 0 THEN '["' || (j ->> '$[0]') || '","' || (j ->> '$[1]') || '"]' ELSE '[]' END
  WHEN j LIKE '{{%' THEN CASE WHEN length(j) > 100 THEN 'Truncated ' || length(j) || ' characters...' ELSE j END ELSE {_CUT} END AS shown
FROM (SELECT event_id, j, CASE WHEN event_id % 8 IN (4, 5) THEN substr(j, 2, length(j) - 2) ELSE j END AS x FROM {_VALUES})""")
def truncate_json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long strings and URLs, arrays, long and short objects, other texts."""
    return _values(spark, sf_dir).select("event_id", text.truncate_value(F.col("j")).alias("shown"))


@query(f"""SELECT event_id, key, CASE WHEN i IS NOT NULL OR length(j) <= 500 THEN x WHEN json_type(value) IN ('OBJECT', 'ARRAY') THEN x ELSE {_CUT} END AS value
FROM (SELECT *, {_SHOWN} AS x FROM ({_PARTS}))""")
def interrupt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five items of an array; a small object as it is; the long strings of a long one cut."""
    rows = _values(spark, sf_dir).where(text.is_complex(F.col("j")))
    return rows.select("event_id", F.explode(text.interrupt_rows(F.col("j"))).alias("r")).select("event_id", "r.key", "r.value")


@query("""SELECT page_id, CASE WHEN length(url) > 100 AND NOT regexp_matches(url, '^https?://[^\\s/?#]+') THEN substr(url, 1, 100) || '...' ELSE url END AS short_url,
  CASE WHEN length(html) > 100 THEN substr(html, 1, 100) || '...' ELSE html END AS short_html, CASE WHEN length(html) > 100 THEN 'Truncated ' || length(html) || ' characters...' ELSE html END AS note FROM pages""")
def truncate_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.truncate_string(F.col("url")).alias("short_url"), text.truncate_string(F.col("html")).alias("short_html"), text.truncate_json(F.col("html")).alias("note"))


@query("SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) || '...' || right(md5(CAST(doc_id AS VARCHAR)), 3) AS short FROM documents")
def id_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.id_abbrev(F.md5(F.col("doc_id").cast("string"))).alias("short"))
