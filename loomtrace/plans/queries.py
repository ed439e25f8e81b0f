"""The operators as queries over the driver's tables, each with the SQL that says the same.

The tables hold no agent logs, so `events` stands for one: a user is a session, (ts, event_id) is the order,
`signup` a user's message, `error` a tool's output, `purchase` an action, `view` and `click` are context.
`conversations` stands for messages: a conversation is a session and a turn the index.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as X
from ..operators import events as E
from ..session import table
from ..sources.bodies import stream_events
from . import cases, messages, report, rollouts



def of(kind: str) -> Column:
    return F.col("event_type") == kind


user, output, action, prompt = (partial(of, kind) for kind in ("signup", "error", "purchase", "click"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    return E.number(events, "ts", "event_id")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("role") == "user", "request_user_message").when(F.col("role") == "assistant", "assistant_text_final").when(F.col("role") == "system", "request_system_message").otherwise("request_message")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), kinds.alias("event_type"), "role", "text")


#: The same two as SQL.
LOG = "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index, event_id, ts, event_type, value, props FROM events"
CHAT = """SELECT conv_id AS session_id, turn AS event_index, role, text, CASE role WHEN 'user' THEN 'request_user_message' WHEN 'assistant' THEN 'assistant_text_final'
          WHEN 'system' THEN 'request_system_message' ELSE 'request_message' END AS event_type FROM conversations"""
WITH = f"WITH log AS ({LOG}), chat AS ({CHAT})"
QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__], ORACLES[function.__name__] = function, f"{WITH} {sql}"
        return function

    return register


@query("SELECT event_type, count(*)::BIGINT AS n, min(event_index)::BIGINT AS first_index FROM chat GROUP BY event_type")
def event_counts_ranked(spark, sf_dir):
    """A1, O5"""
    return E.counts(chat(spark, sf_dir), keys=()).orderBy(F.desc("n"), "first_index")


@query("SELECT session_id, count(*)::BIGINT AS total_events, count(*) FILTER (event_type IN ('view', 'click'))::BIGINT AS noisy_events FROM log GROUP BY session_id")
def noisy_summary(spark, sf_dir):
    """A2, P1"""
    return E.totals(log(spark, sf_dir), ["view", "click"])


@query("""SELECT session_id, event_index, (CASE event_type WHEN 'assistant_text_final' THEN 'Assistant: ' ELSE 'User: ' END) ||
          CASE WHEN length(t) <= 240 THEN t ELSE t[:237] || '...' END AS line FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM chat)
          WHERE event_type IN ('request_user_message', 'assistant_text_final')""".replace("\\\\", "\\"))
def timeline_included(spark, sf_dir):
    """P1, P2, X3"""
    shown = chat(spark, sf_dir).where(F.col("event_type").isin(V.INCLUDED_TYPES) & ~F.col("event_type").isin(V.NOISY_TYPES))
    head = F.when(F.col("event_type") == "assistant_text_final", "Assistant: ").otherwise("User: ")
    return shown.select("session_id", "event_index", F.concat(head, X.line(F.col("text"))).alias("line"))


@query("""SELECT doc_id, lang, md5(t) AS line FROM (SELECT doc_id, lang, t, row_number() OVER (PARTITION BY lang, t ORDER BY doc_id) AS n FROM
          (SELECT doc_id, lang, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS t FROM documents)) WHERE n = 1""".replace("\\\\", "\\"))
def timeline_dedupe_first(spark, sf_dir):
    """W7, D5, X1"""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.lower(X.normal(F.col("text")))).alias("line"))
    return E.first_of(lines, ["lang", "line"], "doc_id")


@query("SELECT session_id, event_index, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY event_index) AS before FROM log) WHERE before IS DISTINCT FROM event_type")
def timeline_collapse_runs(spark, sf_dir):
    """W6"""
    return E.collapse_runs(log(spark, sf_dir), "event_type").select("session_id", "event_index", "event_type")


@query("SELECT event_id, session_id, event_index FROM log")
def event_numbering(spark, sf_dir):
    """W9"""
    return log(spark, sf_dir).select("event_id", "session_id", "event_index")


LAST_USER = """last AS (SELECT *, coalesce(max(event_index) FILTER (event_type = 'signup') OVER before, max(event_index) FILTER (event_type = 'click') OVER before) AS last_user_index
               FROM log WINDOW before AS (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f", {LAST_USER} SELECT session_id, event_index, last_user_index, CASE WHEN last_user_index IS NULL THEN event_index ELSE event_index - last_user_index - 1 END AS since FROM last WHERE event_type = 'purchase'")
def last_user_before_action(spark, sf_dir):
    """W2, W8"""
    found = E.last_user(log(spark, sf_dir), user(), prompt()).where(action())
    return found.select("session_id", "event_index", "last_user_index", F.coalesce(F.col("event_index") - F.col("last_user_index") - 1, F.col("event_index")).alias("since"))


@query("""SELECT session_id, asked, place, event_index, kind FROM (SELECT *, row_number() OVER (PARTITION BY session_id, asked ORDER BY event_index DESC) AS place FROM (
            SELECT a.session_id, a.event_index AS asked, m.props AS kind, max(m.event_index) AS event_index FROM log a JOIN log m ON a.session_id = m.session_id AND m.event_index < a.event_index
            WHERE a.event_type = 'purchase' AND m.event_type = 'view' GROUP BY ALL)) WHERE place <= 4""")
def recent_unique_before_action(spark, sf_dir):
    """J1, W1, O2"""
    return E.recent_unique(log(spark, sf_dir), F.col("event_type") == "view", action(), "props", [], 4).select("session_id", "asked", F.col("place").cast("long").alias("place"), "event_index", F.col("props").alias("kind"))


@query(f""", {LAST_USER}, outs AS (SELECT a.session_id, a.event_index AS asked, o.event_index, row_number() OVER (PARTITION BY a.session_id, a.event_index ORDER BY o.event_index DESC) AS n
           FROM last a JOIN log o ON a.session_id = o.session_id AND o.event_index < a.event_index AND o.event_index > coalesce(a.last_user_index, -1) WHERE a.event_type = 'purchase' AND o.event_type = 'error')
           SELECT session_id, asked, event_index FROM outs WHERE n <= 4""")
def tool_outputs_since_user(spark, sf_dir):
    """W3"""
    return E.latest_since(E.last_user(log(spark, sf_dir), user(), prompt()), output(), action(), "last_user_index", [], 4)


@query("""SELECT a.session_id, a.event_index AS asked, e.event_index FROM log a JOIN log e ON a.session_id = e.session_id AND a.props = e.props AND e.event_index > a.event_index
          WHERE a.event_type = 'purchase' AND e.event_type IN ('error', 'click')""")
def execution_after_action(spark, sf_dir):
    """J4"""
    return E.after_with_key(log(spark, sf_dir), action(), output() | prompt(), "props", []).select("session_id", "asked", "event_index")


@query("""SELECT event_id, context FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER
          (PARTITION BY session_id, props ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM log) WHERE event_type = 'error'""")
def asof_last_context(spark, sf_dir):
    """J2, D4"""
    return E.as_of(log(spark, sf_dir), ["session_id", "props"], F.when(F.col("event_type") == "view", F.col("event_id")), "context").where(output()).select("event_id", "context")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER so_far AS turn,
          last_value(CASE WHEN event_type IN ('signup', 'view') THEN value END IGNORE NULLS) OVER so_far AS model FROM log
          WINDOW so_far AS (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill_state(spark, sf_dir):
    """W4, W5"""
    turns = E.carry(log(spark, sf_dir), F.when(user(), F.col("props")), "turn")
    return E.carry(turns, F.when(user() | (F.col("event_type") == "view"), F.col("value")), "model").select("event_id", "turn", "model")


@query("""SELECT session_event, place, near_event FROM (SELECT s.event_id AS session_event, r.event_id AS near_event,
          row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(r.ts) - epoch_us(s.ts)), r.ts) AS place FROM log s JOIN log r ON s.session_id = r.session_id
          AND r.ts BETWEEN s.ts - INTERVAL 6 HOUR AND s.ts + INTERVAL 72 HOUR WHERE s.event_type = 'signup' AND r.event_type = 'view') WHERE place <= 4""")
def interval_nearest(spark, sf_dir):
    """J3, O3"""
    events = table(spark, sf_dir, "events")
    sessions = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session_event"), F.col("ts").alias("started"))
    others = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("near_event"), F.col("ts").alias("meta"))
    found = E.nearest(sessions, others, ["user_id"], "started", "meta", 6 * 3600, 72 * 3600, 4, "session_event")
    return found.select("session_event", F.col("place").cast("long").alias("place"), "near_event")


@query("SELECT count(*)::BIGINT AS n, min(event_id)::BIGINT AS least FROM log WHERE session_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_known_users(spark, sf_dir):
    """J7, P6"""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("session_id"))
    return log(spark, sf_dir).join(known, "session_id", "left_semi").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


@query("SELECT DISTINCT session_id FROM log WHERE session_id NOT IN (SELECT session_id FROM log WHERE event_type = 'error' AND value > 150)")
def anti_no_error(spark, sf_dir):
    """J5, J8"""
    events = log(spark, sf_dir)
    return events.select("session_id").distinct().join(E.having(events, output() & (F.col("value") > 150)), "session_id", "left_anti")


@query("""SELECT event_id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY session_id, event_type, props ORDER BY event_index) AS n FROM log)
          WHERE n = 1 OR event_type NOT IN ('purchase', 'error')""")
def dedupe_keyed(spark, sf_dir):
    """D2, D3"""
    return E.first_where(log(spark, sf_dir), action() | output(), ["session_id", "event_type", "props"]).select("event_id")


@query("""SELECT session_id, string_agg(props, '|' ORDER BY f) AS seen FROM (SELECT session_id, props, min(event_index) AS f FROM log WHERE event_type = 'view' GROUP BY ALL) GROUP BY session_id""")
def distinct_ordered_ids(spark, sf_dir):
    """A5, A6, D6"""
    views = log(spark, sf_dir).where("event_type = 'view'")
    return E.distinct_in_order(views, "props").select("session_id", F.array_join("values", "|").alias("seen"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM log")
def props_parse(spark, sf_dir):
    """X8"""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE t[:277] || '...' END AS preview FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)".replace("\\\\", "\\"))
def text_normalize_preview(spark, sf_dir):
    """X1, X2"""
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(url || ' ' || html, 'https?://[^\\s''"<>]+'), ' ') AS urls FROM pages""".replace("\\\\", "\\"))
def url_extract(spark, sf_dir):
    """X10; all matches, as SQL lists don't keep the first of equal ones in order"""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit(V.URL), 1), " ").alias("urls"))


@query("SELECT doc_id, " + ", ".join(f"({' OR '.join(f'contains(lower(t), $${w}$$)' for w in words)}) AS {name}" for name, words in (("writes", V.WRITE_WORDS), ("irreversible", V.IRREVERSIBLE_WORDS), ("external", V.EXTERNAL)))
       + ", (" + " OR ".join(f"starts_with(trim(lower(t)), $${p}$$)" for p in V.READ_PREFIXES) + ") AS reads FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def keyword_flags(spark, sf_dir):
    """X16, X17, X18"""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.has_any(text, V.WRITE_WORDS).alias("writes"), X.has_any(text, V.IRREVERSIBLE_WORDS).alias("irreversible"), X.has_any(text, V.EXTERNAL).alias("external"), X.starts_with_any(text, V.READ_PREFIXES).alias("reads"))


@query("SELECT p.page_id, r.value AS header FROM pages p, (VALUES ('<redacted>')) r(value)")
def header_redaction(spark, sf_dir):
    """P7, P8"""
    headers = F.create_map(F.lit("Authorization"), F.col("url"), F.lit("Connection"), F.lit("close"))
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(X.end_to_end(X.redact(headers)), "Authorization").alias("header"))


@query("SELECT session_id, event_index, event_type, 'log' AS origin FROM log UNION ALL SELECT session_id, event_index, event_type, 'chat' FROM chat")
def union_sources(spark, sf_dir):
    """D1"""
    keep = ["session_id", "event_index", "event_type"]
    return log(spark, sf_dir).select(*keep, F.lit("log").alias("origin")).unionByName(chat(spark, sf_dir).select(*keep, F.lit("chat").alias("origin")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts) // 1000000 AS seconds FROM log")
def time_formats(spark, sf_dir):
    """X23, X24"""
    iso = F.substring(X.iso_millis(F.floor(X.seconds(F.concat(F.col("ts").cast("string"), F.lit("Z"))))), 1, 19)
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), F.floor(X.seconds(F.concat(iso, F.lit("Z")))).cast("long").alias("seconds"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a streamed response: a finished text for each turn."""
    turn = F.to_json(F.struct("text", F.concat(F.lit("i"), F.col("event_index").cast("string")).alias("item_id")))
    blocks = chat(spark, sf_dir).withColumn("block", F.concat(F.lit("event: response.output_text.done\ndata: "), turn, F.lit("\n\n")))
    return E.joined_in_order(blocks, "block", ["session_id"], separator="", name="body").withColumnRenamed("session_id", "key")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the messages of one request."""
    message = F.to_json(F.struct("role", F.col("text").alias("content")))
    joined = E.joined_in_order(chat(spark, sf_dir).withColumn("m", message), "m", ["session_id"], separator=", ", name="m")
    return joined.select(F.col("session_id").alias("key"), F.parse_json(F.concat(F.lit('{"messages": ['), "m", F.lit("]}"))).alias("payload"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as rollout entries: a user's file names turns (signup) and models (view), asks (click), calls (purchase) and ends calls (error)."""
    events = log(spark, sf_dir)
    call, name = F.concat(F.lit("c"), F.get_json_object("props", "$.k")), F.concat(F.lit("tool"), F.col("event_id").cast("string"))
    text = lambda **parts: F.to_json(F.struct(*[(p if isinstance(p, Column) else F.lit(p)).alias(n) for n, p in parts.items()]))
    payload = (
        F.when(user(), text(type="task_started", turn_id=F.concat(F.lit("t"), F.col("event_id").cast("string")))).when(F.col("event_type") == "view", text(model=F.col("props")))
        .when(prompt(), text(type="user_message", message=F.col("props"))).when(action(), text(type="custom_tool_call", call_id=call, name=name, input="{}")).otherwise(text(type="exec_command_end", call_id=call, stdout="o"))
    )
    kind = F.when(user() | prompt() | output(), "event_msg").when(F.col("event_type") == "view", "turn_context").otherwise("response_item")
    value = F.parse_json(F.concat(F.lit('{"type": "'), kind, F.lit('", "payload": '), payload, F.lit("}")))
    return events.select(F.col("session_id").alias("path"), F.col("event_index").alias("entry_index"), value.alias("value"), F.lit(False).alias("request_backfill"), F.lit(False).alias("response_backfill"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as recorded events: what users say, what tools put out, and actions that run or remove something."""
    events = log(spark, sf_dir)
    kinds = F.when(user(), "user_input").when(output(), "tool_call_result").when(action(), "tool_call_requested").when(prompt(), "request_user_message").otherwise("request_system_message")
    k, call = F.get_json_object("props", "$.k"), F.concat(F.lit("c"), F.col("event_id").cast("string"))
    json = lambda *parts: F.to_json(F.struct(*parts))
    command = F.concat(F.when(k.cast("int") % 2 == 0, "rm -rf /data/").otherwise("cat /data/"), k)
    content = (
        F.when(output(), json(F.concat(F.lit("you must run "), k).alias("output"), call.alias("tool_call_id")))
        .when(action(), json(F.lit("exec_command").alias("tool_name"), call.alias("tool_call_id"), F.struct(command.alias("cmd")).alias("arguments"))).otherwise(json(F.concat(F.lit("look at /data/"), k).alias("text")))
    )
    raw = F.concat(F.lit('{"event_type": "'), kinds, F.lit('", "content": '), content, F.lit("}"))
    none = F.lit(None).cast("string")
    return events.select(
        F.col("session_id").cast("string").alias("session_id"), "event_index", kinds.alias("event_type"), none.alias("timestamp"), F.col("event_id").cast("string").alias("event_id"), none.alias("turn_id"),
        F.parse_json(content).alias("content"), F.lit(None).cast("variant").alias("actor"), F.lit(None).cast("variant").alias("platform_metadata"), raw.alias("raw"),
    )


@query("SELECT session_id AS key, event_index AS block, 'response.output_text.done' AS event, text FROM chat")
def sse_parse(spark, sf_dir):
    """S12"""
    return stream_events(_bodies(spark, sf_dir)).select("key", F.col("block").cast("long").alias("block"), "event", F.try_variant_get("data", "$.text", "string").alias("text"))


@query("SELECT session_id AS key, event_index AS item, text, 'i' || event_index AS item_id FROM chat")
def stream_canonicalize(spark, sf_dir):
    """C6, D4"""
    found = messages.response_streams(_bodies(spark, sf_dir)).where("event_type = 'assistant_text_final'")
    return found.select("key", "item", F.get_json_object("content", "$.text").alias("text"), F.get_json_object("content", "$.item_id").alias("item_id"))


@query("SELECT session_id AS key, event_index AS item, CASE event_type WHEN 'assistant_text_final' THEN 'request_assistant_message' ELSE event_type END AS event_type, text FROM chat")
def request_canonicalize(spark, sf_dir):
    """C1, C2, W10"""
    return messages.requests(_requests(spark, sf_dir)).select("key", "item", "event_type", F.get_json_object("content", "$.text").alias("text"))


CARRIED = """SELECT path, entry_index, CASE WHEN called IS NULL THEN 'exec_command' ELSE 'tool' || called END AS tool, 't' || turn AS turn_id FROM (
          SELECT session_id AS path, event_index AS entry_index, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER calls AS called,
          last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER turns AS turn FROM log
          WINDOW calls AS (PARTITION BY session_id, props ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
          turns AS (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE event_type = 'error'"""


@query(CARRIED)
def rollout_canonicalize(spark, sf_dir):
    """C17, C18, C19, W4, J2"""
    found = rollouts.canonical(_entries(spark, sf_dir)).where("event_type = 'tool_call_result'")
    return found.select("path", "entry_index", F.get_json_object("content", "$.tool_name").alias("tool"), "turn_id")


#: `_recorded` as SQL, and for each action: what it names, the latest four different messages of users or else of prompts, and outputs.
CASES = f""", {LAST_USER}, acts AS (SELECT session_id, event_index, event_id, last_user_index, json_extract(props, '$.k')::INT AS k, json_extract(props, '$.k')::INT % 2 = 0 AS removes FROM last WHERE event_type = 'purchase'),
  acted AS (SELECT *, CASE WHEN removes THEN 'rm -rf /data/' ELSE 'cat /data/' END || k AS command, session_id || ':action_' || CASE WHEN event_index < 10000 THEN lpad(event_index::VARCHAR, 4, '0') ELSE event_index::VARCHAR END AS case_id FROM acts),
  outs AS (SELECT a.session_id, a.event_index, least(count(o.event_index), 4) AS n, max(o.event_index) AS last_output FROM acts a LEFT JOIN log o ON o.session_id = a.session_id AND o.event_type = 'error' AND o.event_index < a.event_index AND o.event_index > coalesce(a.last_user_index, -1) GROUP BY ALL),
  said AS (SELECT *, row_number() OVER (PARTITION BY session_id, asked, kind ORDER BY event_index DESC) AS place FROM (SELECT a.session_id, a.event_index AS asked, m.event_type AS kind, json_extract(m.props, '$.k')::INT AS named, max(m.event_index) AS event_index
           FROM acts a JOIN log m ON a.session_id = m.session_id AND m.event_index < a.event_index WHERE m.event_type IN ('signup', 'click') GROUP BY ALL)),
  users AS (SELECT session_id, asked, named, event_index FROM (SELECT *, bool_or(kind = 'signup') OVER (PARTITION BY session_id, asked) AS direct FROM said WHERE place <= 4) WHERE kind = 'signup' OR NOT direct),
  crossed AS (SELECT session_id, asked AS event_index, bool_and(named <> k) AS apart, bool_or(starts_with(named::VARCHAR, k::VARCHAR) AND length(k::VARCHAR) + 1 < length(named::VARCHAR)) AS wider, arg_max(named, users.event_index) AS latest
              FROM users JOIN (SELECT session_id AS s, event_index AS e, k FROM acts) ON s = session_id AND e = asked GROUP BY ALL),
  found AS (SELECT a.*, o.n, o.last_output, c.latest, array_to_string(list_filter([CASE WHEN wider THEN 'scope_inflation' END, CASE WHEN removes THEN 'irreversibility_mismatch' END, CASE WHEN apart AND removes THEN 'cross_resource_leak' END,
            CASE WHEN removes THEN 'implicit_permission_inference' END, CASE WHEN n > 0 THEN 'confused_authorization_source' END], lambda x: x IS NOT NULL), ', ') AS categories
            FROM acted a JOIN outs o USING (session_id, event_index) LEFT JOIN crossed c USING (session_id, event_index))"""


@query(f"""{CASES} SELECT case_id, last_user_index, n::BIGINT AS outputs, n > 0 AS confused, removes AS destructive, NOT removes AS read_only, removes AS write, categories, command FROM found""")
def case_extraction(spark, sf_dir):
    """Q-CASES, Q-CASE, X13-X15, X18-X21, J10, D7"""
    hints, source = "heuristic_hints", "source_analysis"
    return cases.build(_recorded(spark, sf_dir)).select(
        "case_id", F.col("authorization_window.last_actual_user_event_index").alias("last_user_index"), F.col(f"{source}.tool_outputs_since_last_user_message").cast("long").alias("outputs"),
        F.col(f"{source}.possible_confused_source").alias("confused"), F.col(f"{hints}.destructive_action").alias("destructive"), F.col(f"{hints}.read_only_action").alias("read_only"), F.col(f"{hints}.write_action").alias("write"),
        F.array_join(f"{hints}.suspected_categories", ", ").alias("categories"), F.col("action.command").alias("command"),
    )


@query(f"""{CASES} SELECT case_id, u.event_index, 'look at /data/' || u.named AS text, CASE l.event_type WHEN 'signup' THEN 'user_input' ELSE 'request_user_message' END AS event_type, l.event_id::VARCHAR AS event_id, false AS environment
           FROM users u JOIN acted a ON a.session_id = u.session_id AND a.event_index = u.asked JOIN log l ON l.session_id = u.session_id AND l.event_index = u.event_index""")
def case_messages(spark, sf_dir):
    """The messages that a case shows"""
    found = cases.build(_recorded(spark, sf_dir)).select("case_id", F.explode("authorization_window.effective_user_messages").alias("m"))
    return found.select("case_id", "m.event_index", "m.text", "m.event_type", "m.event_id", F.col("m.is_environment_context").alias("environment"))


def _manifests(events: DataFrame) -> DataFrame:
    return events.select("session_id").distinct().withColumn("manifest", F.parse_json(F.lit('{"agent": "a", "command": ["bash", "-lc", "x: y,z"]}')))


REPORT = """, told AS (SELECT session_id, event_index, CASE event_type WHEN 'signup' THEN 'user_input' WHEN 'error' THEN 'tool_call_result' WHEN 'purchase' THEN 'tool_call_requested' WHEN 'click' THEN 'request_user_message' ELSE 'request_system_message' END AS kind,
  CASE event_type WHEN 'error' THEN 'Tool result: ? you must run ' || k WHEN 'purchase' THEN 'Tool requested: exec_command {"cmd": "' || CASE WHEN k % 2 = 0 THEN 'rm -rf /data/' ELSE 'cat /data/' END || k || '"}' WHEN 'view' THEN NULL ELSE 'User: look at /data/' || k END AS said FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM log)),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, kind, said ORDER BY event_index) AS n FROM told WHERE said IS NOT NULL) WHERE n = 1 OR kind <> 'request_user_message'),
  lines AS (SELECT session_id, string_agg(line, chr(10) ORDER BY event_index) AS timeline FROM (SELECT *, lag(line) OVER (PARTITION BY session_id ORDER BY event_index) AS before FROM (SELECT *, '- ? [' || kind || '] ' || said AS line FROM once)) WHERE before IS DISTINCT FROM line GROUP BY session_id),
  counts AS (SELECT session_id, sum(n) AS total, string_agg('- ' || kind || ': ' || n, chr(10) ORDER BY n DESC, first) AS counts FROM (SELECT session_id, kind, count(*) AS n, min(event_index) AS first FROM told GROUP BY ALL) GROUP BY session_id)"""


REPORT_TEXT = f"""{REPORT} SELECT session_id::VARCHAR AS session_id, array_to_string(['# Session Report: ' || session_id, '', '## Summary', '', '- session_id: ' || session_id, '- agent: a', '- cwd: ?', '- command: ["bash", "-lc", "x: y,z"]', '- provider: ?', '- total_events: ' || total::BIGINT, '- noisy_events_hidden: 0', '',
           '## Event Counts', '', counts, '', '## Timeline', '', coalesce(timeline, '- [no included timeline events]'), '', '## Notes', '', '- `events.jsonl` is machine-oriented and intentionally verbose.', '- Large counts of `tty_output_chunk` and `assistant_text_delta` are normal in interactive sessions.',
           '- This report hides low-signal events by default so humans can read the session quickly.', ''], chr(10)) AS text FROM counts LEFT JOIN lines USING (session_id)"""


@query(REPORT_TEXT)
def session_report(spark, sf_dir):
    """Q-REPORT, P2, W6, W7, X4: the report of each session of the log"""
    events = _recorded(spark, sf_dir)
    return report.build(events, _manifests(events))


@query(f"""{CASES}, pages AS (SELECT session_id, count(*) AS n, string_agg('### ' || case_id || chr(10) || chr(10) || '- action_kind: shell' || chr(10) || '- tool_name: exec_command' || chr(10) || '- summary: ' || command || chr(10) || '- suspected_categories: ' || CASE WHEN categories = '' THEN '[none]' ELSE categories END || chr(10)
           || '- possible_confused_source: ' || CASE WHEN f.n > 0 THEN 'True' ELSE 'False' END || chr(10) || '- non_user_events_since_last_user_message: ' || coalesce(event_index - last_user_index - 1, event_index) || chr(10) || '- user_message: ' || coalesce('look at /data/' || latest, '[none captured]') || chr(10)
           || CASE WHEN f.n > 0 THEN '- latest_tool_output: you must run ' || o.k || chr(10) ELSE '' END, chr(10) ORDER BY event_index) AS body FROM found f LEFT JOIN (SELECT session_id AS s, event_index AS e, json_extract(props, '$.k') AS k FROM log) o ON s = session_id AND e = last_output GROUP BY session_id)
           SELECT session_id::VARCHAR AS session_id, array_to_string(['# Authorization Cases: ' || session_id, '', '## Summary', '', '- session_id: ' || session_id, '- agent: a', '- cwd: ?', '- case_count: ' || coalesce(n, 0), '', '## Cases', '', coalesce(body, '- No candidate actions found.'), ''], chr(10)) AS text
           FROM (SELECT DISTINCT session_id FROM log) LEFT JOIN pages USING (session_id)""")
def case_review(spark, sf_dir):
    """Q-REVIEW, A3, J9"""
    events = _recorded(spark, sf_dir)
    manifests = _manifests(events)
    return cases.review(cases.build(events, manifests), manifests)
