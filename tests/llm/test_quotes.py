import duckdb

from grantlens.llm import quotes as Q

ROWS = [
    (1, 0, "user", "How do I sort?\nI have a list."), (1, 1, "assistant", "Use sorted().\n"), (1, 2, "user", "On Monday, bot wrote:\n> Use  SORTED().\n\nIn place?"),
    (1, 3, "assistant", "> > Use sorted().\n> In place?\nUse list.sort()."), (1, 4, "user", "> I have a list.\n> How do I sort?\n> Use sorted().\nBack to the first."), (1, 5, "assistant", "Fine."),
    (1, 5, "assistant", "Fine."), (2, 0, "user", None), (2, 1, "assistant", "> nobody said this\nok"), (2, 9000, "user", "> ok\nafter a long time"), (2, 9001, "user", ">\n>> \nx"),
    (None, 0, "user", "> ok"), (3, None, "user", "text"), (4, 0, "", ""),
]


def test_replies_branches_and_sql(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 level", "'x' source")
    got = Q.conversations(rows)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert len(by) == got.count() == 13
    one = [by[1, t] for t in range(6)]
    assert [r.reply_to for r in one] == [None, 0, 1, 2, 0, 4]
    assert [r.branch for r in one] == [None, None, None, None, 4, 4]
    assert [r.text for r in one][2:5] == ["In place?", "Use list.sort().", "Back to the first."]
    assert [(r.quoted_lines, r.linked_lines, r.deepest) for r in one] == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 1), (0, 0, 0)]
    assert one[5].copies == 2 and by[2, 0].text is None
    assert by[2, 9000].reply_to == 1 and by[2, 9001].reply_to == 9000 and by[2, 1].linked_lines == 0
    assert (by[3, None].reply_to, by[None, 0].branch) == (None, None)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    want = con.execute(Q.SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert Q.conversations(rows.limit(0)).count() == 0


WORDS = "the quick brown fox jumps over the lazy dog and then it sleeps for a while"
WRAPPED = [
    (1, 0, "user", f"Hello there.\n{WORDS}\nBye now."), (1, 1, "assistant", "another text about foxes that sleep all day long"),
    (1, 2, "user", "A wrote:\n> the quick  brown FOX jumps\n> over the lazy dog\n>\n> and then it sleeps\nWhy?"),
    (1, 3, "assistant", "> > lazy dog and then it\n> > sleeps for a while\n> about foxes that sleep all\n> day long\nBecause."),
    (1, 4, "user", "> nobody ever said any of this here\n> Bye now.\n> nor was this ever said by them\nok"),
    (1, 5, "user", "the quick brown fox jumps off"), (1, 6, "user", "> quick brown fox jumps over the lazy\n> dog and\nlate"),
]


def test_passages_wrapped_anew_or_cut_inside_lines(spark):
    rows = spark.createDataFrame(WRAPPED, "conv_id long, turn long, role string, text string")
    got = Q.conversations(rows).collect()
    by = {r.turn: r for r in got}
    assert [by[t].reply_to for t in range(7)] == [None, 0, 0, 1, 0, 4, 0]
    assert [by[t].linked_lines for t in range(7)] == [0, 0, 3, 4, 1, 0, 2]
    assert [by[t].deepest for t in (2, 3)] == [1, 2]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", WRAPPED)
    assert sorted(map(str, con.execute(Q.SQL).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_very_long_texts_and_rows_of_marks(spark):
    long = "\n".join(f"line {i} of a long letter" for i in range(20_000))
    quoted = "\n".join("> " + x for x in long.split("\n"))
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "x"), (1, 2, "user", quoted + "\nyes"), (1, 3, "user", ">" * 200_000 + "\nno")],
                                 "conv_id long, turn long, role string, text string")
    by = {r.turn: r for r in Q.conversations(rows).collect()}
    assert (by[2].reply_to, by[2].linked_lines, by[2].text) == (0, 20_000, "yes")
    assert (by[3].deepest, by[3].linked_lines, by[3].text) == (200_000, 0, "no")
