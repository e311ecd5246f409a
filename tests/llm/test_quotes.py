from pyspark.sql import functions as F

from paywarden.llm.common import table
from paywarden.llm.quotes import link_quotes, parse_message, quote_levels


def test_levels_and_announcements():
    text = "Hi\n\nOn Monday, A wrote:\n> one\n>> two\n> > still two\n\nOn Tuesday 1 May 2020,\nB wrote:\n> three\nJD> four\nend\n-----Original Message-----\nFrom: x\nSubject: y\n\nbelow\n> deeper"
    assert [(n, x) for n, x in quote_levels(text) if x] == [
        (0, "Hi"), (1, "one"), (2, "two"), (2, "still two"), (1, "three"), (1, "four"), (0, "end"), (1, "below"), (2, "deeper"),
    ]
    assert parse_message(text)[0] == "Hi\n\nend"
    assert parse_message("I wrote:\nnothing") == ("I wrote:\nnothing", parse_message("i  WROTE:\nnothing")[1], [])
    assert parse_message("") == ("", [], [])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, hash string")


def test_links_threads_and_order(spark):
    rows = [
        (1, 0, "a", "How do we\nsort this?"), (1, 1, "b", "A second question entirely."), (1, 2, "c", "> How do we sort\n> this?\nLike so."),
        (1, 3, "d", "> A second question entirely.\n\nYes."), (1, 4, "e", "> > How do we\n> > sort this?\n>\n> Like so.\n\nThanks"),
        (1, 5, "f", "> never said\nHm"), (2, 0, "a", "> How do we sort this?\nelsewhere"), (None, 3, "n", "> x\nnull"), (2, None, "n", None),
        (1, 6, "g", "Like so."), (1, 7, "h", "> Like so.\n> not this"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in link_quotes(frame(spark, rows)).collect()}
    assert {k: r["parent_turn"] for k, r in got.items() if k[0] == 1} == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): 2, (1, 5): None, (1, 6): None, (1, 7): 2}
    assert [t for _, t in sorted((r["position"], k[1]) for k, r in got.items() if k[0] == 1)] == [0, 2, 4, 7, 1, 3, 5, 6]
    assert got[1, 4]["body"] == "Thanks" and (got[1, 4]["n_quotes"], got[1, 4]["n_linked"]) == (2, 2)
    assert (got[1, 5]["n_quotes"], got[1, 5]["n_linked"]) == (1, 0) and got[2, 0]["parent_turn"] is None
    assert got[None, 3]["position"] is None and got[2, None]["body"] == ""


def test_empty_and_repeated_rows(spark):
    assert link_quotes(frame(spark, [])).count() == 0
    got = link_quotes(frame(spark, [(1, 0, "a", "x y"), (1, 0, "a", "x y"), (1, 1, "b", "> x y\nz")])).collect()
    assert sorted(r["position"] for r in got) == [1, 2, 3] and [r["parent_turn"] for r in got if r["turn"] == 1] == [0]


def test_mail_made_from_the_conversations(spark):
    """Every message quotes the one before it: each link goes there, unless an earlier message says the same."""
    conv = table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text")
    rows = sorted((tuple(r) for r in conv.collect()), key=lambda r: r[:2])
    mail, first, want = [], {}, {}
    for k, (c, t, role, text) in enumerate(rows):
        before = rows[k - 1] if k and rows[k - 1][0] == c else None
        quoted = "On day 1, someone wrote:\n" + "\n".join("> " + x for x in before[3].split("\n")) + "\n\n" if before else ""
        mail.append((c, t, role, quoted + text))
        first.setdefault((c, " ".join(text.lower().split())), t)
        if before:
            want[c, t] = first[c, " ".join(before[3].lower().split())]
    got = {(r["conv_id"], r["turn"]): r for r in link_quotes(frame(spark, mail)).collect()}
    assert {k: r["parent_turn"] for k, r in got.items() if r["parent_turn"] is not None} == want
    assert all(got[c, t]["body"] == text.strip() for c, t, _, text in rows)
    plain = link_quotes(conv)
    assert plain.where("n_quotes > 0 OR parent_turn IS NOT NULL").count() == 0
    assert plain.groupBy("conv_id").agg(F.max("position").alias("p"), F.count("*").alias("n")).where("p <> n").count() == 0


def test_a_million_lines_take_one_pass():
    import time

    start = time.perf_counter()
    assert len(quote_levels("\n" * 1_000_000)) == 1_000_001
    odd = "A wrote:\n\n\n" * 100_000 + "On Monday, A wrote:\n" + "\n" * 200_000 + "> q"
    levels = quote_levels(odd)
    assert levels[-1] == (1, "q") and "On Monday, A wrote:" not in {x for _, x in levels}
    assert parse_message(odd)[2] and time.perf_counter() - start < 30
