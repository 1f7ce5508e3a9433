"""Chat formatting by linking quotations.

Quoted lines are parsed with their nesting level; neighbouring lines of one level are a passage, whatever lines a
mail client wrapped it into. The hashes of a passage's word windows are joined to the latest earlier message of the
conversation that has them among its own words, and the passage is linked to the message that most of them come from.
A passage without such a message is linked line by line. A message replies to the message that most of its
first-level quoted lines come from, and without such quotes to the message before it. One that replies to something
else begins a branch; within a branch messages stand in order of their replies, and quotes are left out of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlens.functions.text import let
from grantlens.llm.common import written

QUOTED = r"^[ \t]*>"
#: The marks at the beginning of a quoted line.
MARKS = r"^[ \t>]*>"
SPACES = r"[\x20\x09-\x0D]+"
#: The line that announces a quote, for example "On Monday, A wrote:".
ANNOUNCES = r"(?i)\b(wrote|writes|schrieb|escribió|a écrit) ?:\s*$"
#: Words of a window. Passages with fewer words are linked by whole lines only.
WINDOW = 5
#: Turns of a conversation that one task looks at in order; the state before them comes from sums per bucket.
BUCKET_TURNS = 1024


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def level(line: Column) -> Column:
    """Quote levels of a line: its leading marks."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))


def normalised(line: Column) -> Column:
    """A line without marks, case and repeated spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), SPACES, " ")))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without lines that announce them; blank lines around are trimmed."""
    def without_quotes(all_lines: Column) -> Column:
        def kept(line: Column, i: Column) -> Column:
            following = F.coalesce(F.get(all_lines, i + 1), F.lit(""))
            return ~line.rlike(QUOTED) & ~(line.rlike(ANNOUNCES) & following.rlike(QUOTED))

        return F.regexp_replace(F.array_join(F.filter(all_lines, kept), "\n"), r"^\s+|\s+$", "")

    return F.when(text.isNotNull(), let(lines(text), without_quotes))


def passages(text: Column) -> Column:
    """Array of (level, lines): runs of neighbouring lines of one level, 0 for the message's own; lines normalised, blank ones left out."""
    def runs(all_lines: Column, levels: Column, starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(all_lines))
            return F.struct(F.get(levels, start).alias("level"),
                            F.filter(F.transform(F.slice(all_lines, start + 1, end - start), normalised), lambda x: x != "").alias("lines"))

        return F.transform(starts, run)

    def starts(levels: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(levels) - 1), lambda i: (i == 0) | (F.get(levels, i) != F.get(levels, i - 1)))

    return let(lines(text), lambda ls: let(F.transform(ls, level), lambda levels: let(starts(levels), lambda at: runs(ls, levels, at))))


def keys(said: Column) -> Column:
    """Array of (kind, hash) of normalised lines: windows over their words ('w') and the lines themselves ('l'), with repeats."""
    def windows(words: Column) -> Column:
        at = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit("w").alias("kind"), F.xxhash64(F.array_join(F.slice(words, i, WINDOW), " ")).alias("hash")))

    whole = F.transform(said, lambda x: F.struct(F.lit("l").alias("kind"), F.xxhash64(x).alias("hash")))
    return F.concat(let(F.split(F.array_join(said, " "), " "), windows), whole)


def carried(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """`rows` with the largest `value` of strictly earlier turns of the same keys (null if none).

    Within a bucket of turns by a window, from earlier buckets by their largest values, so that one long
    conversation is spread over its buckets.
    """
    bucket = F.floor(F.col("turn") / BUCKET_TURNS)
    rows = rows.withColumn("bucket", bucket)
    inside = Window.partitionBy(*keys, "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    best = rows.groupBy(*keys, "bucket").agg(F.max(value).alias("best"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    best = best.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("bucket").alias("k_bucket"), F.max("best").over(before).alias("earlier"))
    same = F.col("bucket").eqNullSafe(F.col("k_bucket"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    rows = rows.withColumn("within", F.max(value).over(inside)).join(best, same, "left")
    return rows.withColumn(name, F.coalesce("within", "earlier")).drop("bucket", "within", "earlier", "k_bucket", *[f"k_{k}" for k in keys])


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source, lines): how many quoted lines of each level come from which earlier message.

    Every window of a passage comes from the latest earlier message that has it, so no pairs of messages arise. A
    passage is whole-linked when one message gives at least half of its windows (ties: the later message).
    """
    quoting = messages.filter(F.col("text").rlike("(?m)" + QUOTED))
    parts = quoting.select("conv_id", "turn", F.xxhash64("role", "text").alias("message"), F.posexplode(passages(F.col("text"))).alias("part", "passage"))
    parts = parts.filter("passage.level > 0 and size(passage.lines) > 0")
    asks = parts.select("conv_id", "turn", "message", "part", "passage.level", F.size("passage.lines").alias("height"), F.explode(keys(F.col("passage.lines"))).alias("key"))
    passage = ["conv_id", "turn", "message", "part", "level", "height"]
    asks = asks.groupBy(*passage, "key.kind", "key.hash").agg(F.count("*").alias("n"))
    # Only conversations that quote at all have their own words hashed.
    own = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    own_lines = F.flatten(F.transform(F.filter(passages(F.col("text")), lambda p: p.level == 0), lambda p: p.lines))
    own = own.select("conv_id", "turn", F.explode(keys(own_lines)).alias("key")).select("conv_id", "turn", "key.kind", "key.hash").distinct()
    both = own.withColumn("said", F.col("turn")).unionByName(asks, allowMissingColumns=True)
    found = carried(both, ["conv_id", "kind", "hash"], "said", "source").filter("n is not null")
    found = found.groupBy(*passage, "kind", "source").agg(F.sum("n").alias("n"))
    is_window, has_source = F.col("kind") == "w", F.col("source").isNotNull()
    found = found.groupBy(*passage).agg(
        F.sum(F.when(is_window, F.col("n"))).alias("windows"),
        F.max(F.when(is_window & has_source, F.struct("n", "source"))).alias("most"),
        # At most as many as the passage, which is part of one text, has lines.
        F.collect_list(F.when(~is_window & has_source, F.struct("source", F.col("n").alias("lines")))).alias("by_line"))
    whole = F.array(F.struct(F.col("most.source").alias("source"), F.col("height").cast("long").alias("lines")))
    found = found.select("conv_id", "turn", "level", F.explode(F.when(2 * F.col("most.n") >= F.col("windows"), whole).otherwise(F.col("by_line"))).alias("link"))
    return found.groupBy("conv_id", "turn", "level", "link.source").agg(F.sum("link.lines").alias("lines"))


def conversations(rows: DataFrame) -> DataFrame:
    """Messages with their replies: conv_id, turn, role, text (without quotes), copies, quoted_lines, linked_lines, deepest, reply_to, branch.

    One row per distinct message; `copies` counts repeated rows. reply_to is null for the first message
    of a conversation. linked_lines are the lines of linked passages and the lines linked by themselves. branch is the turn at which a message's branch begins, null in the first one; ordered by
    branch (null first) and turn, every message but a branch's first follows the one it replies to.
    Null texts stay null and have no quotes. A null turn or conv_id takes no part in linking: such rows
    have no reply_to and no branch. Several messages of one turn share links and branch. An empty table gives no rows.
    """
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    kept = written(kept.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "chat-messages")
    known = kept.filter("conv_id is not null and turn is not null")
    found = written(links(known), "chat-links")
    best = found.filter("level = 1").groupBy("conv_id", "turn").agg(F.max_by("source", F.struct("lines", "source")).alias("quoted"))
    counts = found.groupBy("conv_id", "turn").agg(F.sum("lines").alias("linked_lines"))
    turns = known.select("conv_id", "turn").distinct().withColumn("at", F.col("turn"))
    turns = carried(turns, ["conv_id"], "at", "previous").join(best, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left")
    turns = turns.withColumn("reply_to", F.coalesce("quoted", "previous"))
    turns = turns.withColumn("begins", F.when(F.col("quoted") != F.col("previous"), F.col("turn")))
    turns = carried(turns, ["conv_id"], "begins", "running").select("conv_id", "turn", "reply_to", F.coalesce("begins", "running").alias("branch"), "linked_lines")
    quoted = F.filter(lines(F.col("text")), lambda x: x.rlike(QUOTED))
    deepest = F.coalesce(F.array_max(F.transform(quoted, level)), F.lit(0))
    out = kept.join(turns, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"), "copies", F.size(quoted).alias("quoted_lines"),
                      F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"), deepest.cast("int").alias("deepest"), "reply_to", "branch")


SQL = r"""
with kept as (select conv_id, turn, role, text, count(*) as copies from conversations group by all),
l as (select *, row_number() over () as m, string_split_regex(coalesce(text, ''), '\r?\n') as ls from kept),
x as (select conv_id, turn, m, unnest(ls) as x, generate_subscripts(ls, 1) as i from l),
s as (select conv_id, turn, m, i, length(regexp_replace(regexp_extract(x, '^[ \t>]*>'), '[ \t]', '', 'g')) as level,
  lower(trim(regexp_replace(regexp_replace(x, '^[ \t>]*>', ''), '[\x20\x09-\x0D]+', ' ', 'g'))) as said from x),
r as (select *, i - row_number() over (partition by m, level order by i) as part from s),
p as (select conv_id, turn, m, level, case when level > 0 then part end as part, list(said order by i) as lines from r where said <> '' group by all),
w as (select *, len(lines) as height, string_split(array_to_string(lines, ' '), ' ') as words from p),
k as (select *, 'w' as kind, unnest(list_transform(range(1, len(words) - 3), lambda j: array_to_string(words[j:j + 4], ' '))) as key from w
  union all select *, 'l' as kind, unnest(lines) as key from w),
o as (select distinct conv_id, turn, kind, key from k where level = 0),
q as (select conv_id, turn, m, level, part, height, kind, key, count(*) as n from k where level > 0 and conv_id is not null and turn is not null group by all),
f as (select q.conv_id, q.turn, m, level, part, height, q.kind, q.key, n, max(o.turn) as source from q
  left join o on o.conv_id = q.conv_id and o.kind = q.kind and o.key = q.key and o.turn < q.turn group by all),
g as (select conv_id, turn, m, level, part, height, source, sum(n) as n, sum(sum(n)) over (partition by m, level, part) as windows from f where kind = 'w' group by conv_id, turn, m, level, part, height, source),
most as (select * from g where source is not null qualify row_number() over (partition by m, level, part order by n desc, source desc) = 1),
whole as (select * from most where 2 * n >= windows),
v as (select conv_id, turn, level, source, sum(n) as n from (select conv_id, turn, level, source, height as n from whole
  union all select conv_id, turn, level, source, n from f where kind = 'l' and source is not null and not exists (select 1 from whole where whole.m = f.m and whole.level = f.level and whole.part = f.part))
  group by conv_id, turn, level, source),
best as (select conv_id, turn, source as quoted from v where level = 1 qualify row_number() over (partition by conv_id, turn order by n desc, source desc) = 1),
counts as (select conv_id, turn, sum(n) as linked from v group by all),
t as (select d.conv_id, d.turn, lag(d.turn) over (partition by d.conv_id order by d.turn) as previous, best.quoted, counts.linked
  from (select distinct conv_id, turn from kept where conv_id is not null and turn is not null) d left join best using (conv_id, turn) left join counts using (conv_id, turn)),
b as (select *, max(case when quoted <> previous then turn end) over (partition by conv_id order by turn) as branch from t)
select l.conv_id, l.turn, l.role, case when l.text is not null then regexp_replace(array_to_string(list_filter(ls, lambda x, i: not regexp_matches(x, '^[ \t]*>')
   and not (regexp_matches(x, '(?i)\b(wrote|writes|schrieb|escribió|a écrit) ?:\s*$') and regexp_matches(coalesce(ls[i + 1], ''), '^[ \t]*>'))), chr(10)), '^\s+|\s+$', '', 'g') end as text,
 l.copies, cast(len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*>'))) as integer) as quoted_lines, cast(coalesce(b.linked, 0) as bigint) as linked_lines,
 cast(coalesce(list_max(list_transform(ls, lambda x: length(regexp_replace(regexp_extract(x, '^[ \t>]*>'), '[ \t]', '', 'g')))), 0) as integer) as deepest,
 coalesce(b.quoted, b.previous) as reply_to, b.branch
from l left join b on b.conv_id = l.conv_id and b.turn = l.turn
"""
