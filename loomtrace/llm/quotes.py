"""Quotation linking: conversations in reply order, without their quotes.

A line's level is the number of `>` in its leading run of `>`, spaces and tabs.
A passage is a maximal run of lines of one level above zero; a paragraph is a
maximal run of a message's own lines with words. A line that ends with `wrote:`
right before a quoted line belongs to the quote. Text is normalised for
comparison: A-Z in lower case, spaces, tabs and carriage returns as one space,
empty lines left out.

What a quote can point at are whole messages, paragraphs and lines, each by two
64-bit hashes of its normalised form. Its original is the earliest message of
the conversation that has it as its own text, before the message that quotes
it. A passage takes the original of its whole, or else of its longest line that
has one (the first of equally long ones); if neither is in the conversation, a
whole passage may come from elsewhere, which is counted but orders nothing.

A message replies to the original of its quotes, of those of the least level
that have one to the latest. Replies are followed to the root by doubling.
Ordered by thread (turn of the root), depth and turn, every message comes after
the one it answers; without quotes that is the order of turns.

Only DataFrame functions are used. Originals are aggregated by hash before any
join, so a passage that everyone quotes or writes is one row on one side of it.
Null texts are empty. Null conversations are one conversation; a null turn is
never quoted or linked. Rows of one turn are each parsed for themselves, and as
a parent the turn has the earliest of their originals. Repeated rows repeat;
very long messages are parsed whole; an empty table gives no rows. Other columns
stay as they are, whatever their names, but for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MARK = r"^(?:[ \t]*>)+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of lines besides levels of quotes.
OWN, BLANK, ATTRIBUTION = 0, -1, -2
FOUND = ("text", "reply_to", "thread", "depth", "n_quotes", "n_linked", "n_elsewhere", "formatted")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, CAPITALS, SMALL), r"[ \t\r]+", " "))


def _hashes(unit: Column) -> list[Column]:
    return [F.xxhash64(unit).alias("h1"), F.xxhash64(F.lit(7), unit).alias("h2")]


def parse(messages: DataFrame) -> DataFrame:
    """`messages` with own (their text without quotes), quotes (level, lines) and units (what can be quoted from them)."""
    lines = messages.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    level = F.transform("_lines", lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[ \t]", "")))
    normal = F.transform("_lines", lambda line: _normal(F.regexp_replace(line, MARK, "")))
    marked = lines.withColumn("_level", level).withColumn("_normal", normal).withColumn("_at", F.sequence(F.lit(0), F.size("_lines") - 1))

    def kind(at: Column) -> Column:
        quoted_next = F.coalesce(F.get("_level", at + 1), F.lit(0)) > 0
        own = F.get("_normal", at)
        return F.when(F.get("_level", at) > 0, F.get("_level", at)).when(own == "", BLANK).when(quoted_next & own.endswith("wrote:"), ATTRIBUTION).otherwise(OWN)

    kinds = marked.withColumn("_kind", F.transform("_at", kind))
    cuts = kinds.withColumn("_cut", F.filter("_at", lambda at: (at == 0) | (F.get("_kind", at) != F.get("_kind", at - 1))))
    ends = cuts.withColumn("_end", F.concat(F.slice("_cut", F.lit(2), F.size("_cut")), F.array(F.size("_lines"))))
    run = lambda a, b: F.struct(F.get("_kind", a).alias("kind"), F.filter(F.slice("_normal", a + 1, b - a), lambda line: line != "").alias("lines"))
    runs = ends.withColumn("_runs", F.zip_with("_cut", "_end", run))
    own = F.array_join(F.transform(F.filter("_at", lambda at: F.get("_kind", at).isin(OWN, BLANK)), lambda at: F.get("_lines", at)), "\n")
    own_lines = F.transform(F.filter("_at", lambda at: F.get("_kind", at) == OWN), lambda at: F.get("_normal", at))
    quotes = F.filter("_runs", lambda r: (r["kind"] > 0) & (F.size(r["lines"]) > 0))
    paragraphs = F.transform(F.filter("_runs", lambda r: r["kind"] == OWN), lambda r: F.array_join(r["lines"], " "))
    whole = F.array_join(own_lines, " ")
    is_plain = ~F.exists("_kind", lambda k: (k > 0) | (k == ATTRIBUTION))
    return runs.select(
        *[f"`{name}`" for name in messages.columns],
        F.when(is_plain, F.coalesce("text", F.lit(""))).otherwise(F.regexp_replace(own, r"^[ \t\r\n]+|[ \t\r\n]+$", "")).alias("_own"),
        quotes.alias("_quotes"),
        F.filter(F.array_distinct(F.concat(F.array(whole), paragraphs, own_lines)), lambda u: u != "").alias("_units"),
    )


def links(parsed: DataFrame) -> DataFrame:
    """For each quoting row (conv_id, turn, _row): reply_to, n_linked, n_elsewhere."""
    units = parsed.select("conv_id", "turn", F.explode("_units").alias("unit")).where(F.col("turn").isNotNull()).select("conv_id", "turn", *_hashes(F.col("unit")))
    passages = parsed.select("conv_id", "turn", "_row", F.posexplode("_quotes").alias("passage", "quote")).distinct()
    whole = F.struct(F.lit(1).alias("whole"), F.lit(0).alias("size"), F.lit(0).alias("at"), F.array_join("quote.lines", " ").alias("unit"))
    lines = F.transform("quote.lines", lambda line, at: F.struct(F.lit(0).alias("whole"), F.length(line).alias("size"), (-at).alias("at"), line.alias("unit")))
    asked = cut(passages.select("conv_id", "turn", "_row", "passage", "quote.kind", F.explode(F.concat(F.array(whole), lines)).alias("ask")).select("conv_id", "turn", "_row", "passage", "kind", "ask.whole", "ask.size", "ask.at", *_hashes(F.col("ask.unit"))))
    # Only what is quoted anywhere is looked up; of that, each hash and conversation is one row.
    wanted = asked.select("h1", "h2").distinct()
    originals = cut(units.join(wanted, ["h1", "h2"], "left_semi").groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("original")))
    there = originals.select(F.col("conv_id").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "original")
    here = asked.join(there, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("original") < F.col("turn")))
    key = ["conv_id", "turn", "_row", "passage", "kind"]
    linked = cut(here.groupBy(*key).agg(F.max_by("original", F.struct("whole", "size", "at")).alias("original")))
    by_hash = originals.groupBy("h1", "h2").agg(F.min(F.col("conv_id").isNull()).alias("_no_null"), F.min("conv_id").alias("_low"), F.max("conv_id").alias("_high"), F.max(F.col("conv_id").isNull()).alias("_null"))
    outside = asked.where("whole = 1").join(by_hash, ["h1", "h2"]).where(F.when(F.col("conv_id").isNull(), ~F.col("_no_null")).otherwise(F.col("_null") | (F.col("_low") != F.col("conv_id")) | (F.col("_high") != F.col("conv_id"))))
    both = linked.withColumn("here", F.lit(1)).unionByName(outside.select(*key).withColumn("here", F.lit(0)), allowMissingColumns=True)
    per_passage = both.groupBy(*key).agg(F.max("original").alias("original"))
    found = F.col("original").isNotNull()
    return per_passage.groupBy("conv_id", "turn", "_row").agg(
        F.max_by("original", F.when(found, F.struct(-F.col("kind"), F.col("original")))).alias("reply_to"),
        F.count(F.when(found, 1)).alias("n_linked"), F.count(F.when(~found, 1)).alias("n_elsewhere"),
    )


def roots(edges: DataFrame) -> DataFrame:
    """conv_id, turn, root and depth of every turn that replies, from one edge (conv_id, turn, up) of each; earlier turns only."""
    paths = cut(edges.select("conv_id", "turn", "up", F.lit(1).cast("long").alias("depth")))
    while True:
        above = paths.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        further = paths.join(above, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("up") == F.col("_turn")), "left")
        paths, before = cut(further.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved"))), paths
        if paths.where("moved").isEmpty():
            return before.select("conv_id", "turn", F.col("up").alias("root"), "depth")
        paths = paths.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, turn, role, text) with text without quotes and reply_to, thread, depth, n_quotes, n_linked,
    n_elsewhere and formatted (replacing columns of these names). Sort by conv_id, thread, depth, turn for reply order."""
    others = [name for name in messages.columns if name not in FOUND and name not in ("conv_id", "turn", "role")]
    # Other columns travel as one struct, so that no name of theirs can clash.
    rest = (F.struct(*[f"`{name}`" for name in others]) if others else F.lit(None).cast("string")).alias("_rest")
    rows = cut(parse(messages.select("conv_id", "turn", "role", "text", rest).withColumn("_row", F.xxhash64("role", "text"))))
    quoting = rows.where(F.size("_quotes") > 0)
    known = cut(links(rows.select("conv_id", "turn", "_row", "_quotes", "_units"))).withColumnsRenamed({"conv_id": "_conv", "turn": "_turn", "_row": "_key"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
    met = quoting.join(known, same & (F.col("_row") == F.col("_key")), "left").drop("_conv", "_turn", "_key")
    edges = known.where(F.col("reply_to").isNotNull()).groupBy(F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn")).agg(F.min("reply_to").alias("up"))
    tree = roots(edges).withColumnsRenamed({"conv_id": "_conv", "turn": "_turn", "depth": "_depth"})
    placed = met.join(tree, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("reply_to") == F.col("_turn")), "left")
    # Messages without quotes take no part in the joins.
    plain = rows.where(F.size("_quotes") == 0)
    every = placed.unionByName(plain, allowMissingColumns=True)
    replies = F.col("reply_to").isNotNull()
    return every.select(
        "conv_id", "turn", "role", *[F.col(f"_rest.`{name}`") for name in others], F.col("_own").alias("text"), "reply_to",
        F.coalesce("root", "reply_to", "turn").alias("thread"),
        F.when(replies, 1 + F.coalesce("_depth", F.lit(0))).otherwise(0).cast("long").alias("depth"),
        F.size("_quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("n_elsewhere", F.lit(0)).cast("long").alias("n_elsewhere"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "_own", F.lit("\n")).alias("formatted"),
    )


#: The same for a table `conversations` of conv_id, turn, role and text, for the columns that the query returns.
SQL = r"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS id FROM conversations
), lines AS (
    SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM raw
), marked AS (
    SELECT id, conv_id, turn, n, line,
           length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[ \t]', '', 'g')) AS level,
           trim(regexp_replace(translate(regexp_replace(line, '^(?:[ \t]*>)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r]+', ' ', 'g'), ' ') AS norm
    FROM lines
), kinds AS (
    SELECT *, CASE WHEN level > 0 THEN level WHEN norm = '' THEN -1
                   WHEN norm LIKE '%wrote:' AND coalesce(lead(level) OVER (PARTITION BY id ORDER BY n), 0) > 0 THEN -2 ELSE 0 END AS kind
    FROM marked
), cuts AS (
    SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY id ORDER BY n) THEN 1 ELSE 0 END AS starts FROM kinds
), runs AS (
    SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY n) AS run FROM cuts
), blocks AS (
    SELECT id, conv_id, turn, run, kind, string_agg(norm, ' ' ORDER BY n) AS unit FROM runs WHERE norm <> '' AND kind >= 0 GROUP BY ALL
), units AS (
    SELECT conv_id, turn, unit FROM blocks WHERE kind = 0
    UNION SELECT conv_id, turn, norm FROM runs WHERE kind = 0
    UNION SELECT conv_id, turn, string_agg(norm, ' ' ORDER BY n) FROM runs WHERE kind = 0 GROUP BY id, conv_id, turn
), originals AS (
    SELECT conv_id, unit, min(turn) AS original FROM units WHERE turn IS NOT NULL GROUP BY ALL
), asked AS (
    SELECT id, conv_id, turn, run, kind, 1 AS whole, 0 AS size, 0 AS place, unit FROM blocks WHERE kind > 0
    UNION ALL SELECT id, conv_id, turn, run, kind, 0, length(norm), -n, norm FROM runs WHERE kind > 0 AND norm <> ''
), linked AS (
    SELECT a.id, a.run, any_value(a.kind) AS kind, arg_max(o.original, (a.whole, a.size, a.place)) AS original
    FROM asked a JOIN originals o ON a.conv_id IS NOT DISTINCT FROM o.conv_id AND a.unit = o.unit AND o.original < a.turn GROUP BY a.id, a.run
), elsewhere AS (
    SELECT a.id, a.run FROM asked a WHERE a.whole = 1
        AND EXISTS (SELECT 1 FROM originals o WHERE o.unit = a.unit AND o.conv_id IS DISTINCT FROM a.conv_id)
        AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.id = a.id AND l.run = a.run)
), replies AS (
    SELECT raw.id, raw.conv_id, raw.turn, arg_max(original, (-kind, original)) AS reply_to, count(*) AS n_linked FROM linked JOIN raw USING (id) GROUP BY ALL
), edges AS (
    SELECT conv_id, turn, min(reply_to) AS up FROM replies GROUP BY ALL
), tree AS (
    SELECT id, conv_id, reply_to AS root, 1 AS depth FROM replies
    UNION ALL SELECT t.id, t.conv_id, e.up, t.depth + 1 FROM tree t JOIN edges e ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.root = e.turn
), ends AS (
    SELECT id, min(root) AS root, max(depth) AS depth FROM tree GROUP BY id
), own AS (
    SELECT id, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE kind IN (0, -1)) AS own, bool_or(kind > 0 OR kind = -2) AS cut_out FROM kinds GROUP BY id
), counted AS (
    SELECT id, count(*) AS n FROM blocks WHERE kind > 0 GROUP BY id
), outside AS (
    SELECT id, count(*) AS n FROM elsewhere GROUP BY id
)
SELECT r.conv_id, r.turn, r.role, CASE WHEN o.cut_out THEN regexp_replace(coalesce(o.own, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') ELSE r.text END AS text,
       p.reply_to, coalesce(e.root, r.turn) AS thread, coalesce(e.depth, 0)::BIGINT AS depth, coalesce(c.n, 0)::BIGINT AS n_quotes,
       coalesce(p.n_linked, 0)::BIGINT AS n_linked, coalesce(x.n, 0)::BIGINT AS n_elsewhere
FROM raw r JOIN own o USING (id) LEFT JOIN replies p USING (id) LEFT JOIN ends e USING (id) LEFT JOIN counted c USING (id) LEFT JOIN outside x USING (id)
"""
