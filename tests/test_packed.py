from collections import Counter

from evispark.operators import packed as P
from evispark.operators.packed import parses, unpack

TRAINING = ["HIP 920 C, 2 hour, 1000 bar", "grinding", "machining 0.5 mm/side", "quench and temper 450 C", "double ageing 720/620 C, 4+4 h", "stress relief 650 °C/2 h", "chemical etching"]


def run(spark, scratch, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000 + i, t, "x") for i, t in enumerate(TRAINING * 20)]
    df = spark.createDataFrame(rows, "row_id long, post_processing string, item_pos string")
    out = unpack(df, "post_processing", scratch).where("row_id < 1000").orderBy("row_id", "item_pos").collect()
    found = {}
    for r in out:
        found.setdefault(r.row_id, []).append(r.item_text)
        assert r.item_pos == len(found[r.row_id])
    return found


def test_dialects(spark, scratch):
    h = "HIP 920 C, 2 hour, 1000 bar"
    texts = [
        f"grinding; {h} ;; chemical etching;", "machining 0.5 mm/side / grinding", f"1) grinding 2) {h}", "[1] grinding\n[2] grinding",
        "- grinding\n- chemical etching", '"electro""mirror"" polishing","grinding"', "grinding and quench and temper 450 C",
        "Step 1: grinding Step 2: chemical etching", f"{h}, followed by grinding", "solution anneal (650 C; 3 h; Ar quench); grinding", "grinding -> grinding => chemical etching",
        None, "", "   ", "grinding", "none", "double ageing 720/620 C, 4+4 h + grinding",
    ]
    found = run(spark, scratch, texts)
    assert found[0] == ["grinding", h, "chemical etching"]
    assert found[1] == ["machining 0.5 mm/side", "grinding"]
    assert found[2] == ["grinding", h]
    assert found[3] == ["grinding", "grinding"]
    assert found[4] == ["grinding", "chemical etching"]
    assert found[5] == ['electro"mirror" polishing', "grinding"]
    assert found[6] == ["grinding", "quench and temper 450 C"]
    assert found[7] == ["grinding", "chemical etching"]
    assert found[8] == [h, "grinding"]
    assert found[9] == ["solution anneal (650 C; 3 h; Ar quench)", "grinding"]
    assert found[10] == ["grinding", "grinding", "chemical etching"]
    assert not {11, 12, 13} & set(found)
    assert found[14] == ["grinding"] and found[15] == ["none"]
    assert found[16] == ["double ageing 720/620 C, 4+4 h", "grinding"]


def test_empty_table_and_long_text(spark, scratch):
    empty = spark.createDataFrame([], "row_id long, post_processing string")
    assert unpack(empty, "post_processing", scratch).count() == 0
    long = "; ".join(["grinding"] * 5000)
    assert len(run(spark, scratch, [long])[0]) == 5000


def test_brackets_and_quotes_are_never_divided():
    for text in ["a (b; c) d", '"x; y"; z', "a [b | c]"]:
        for _, values in parses(text):
            assert all(v.count("(") == v.count(")") and v.count("[") == v.count("]") for v in values)


def test_the_cheapest_parse_is_chosen():
    known = dict(Counter({P.shape(t): 20 for t in TRAINING}))
    total = sum(known.values())
    for text in ["grinding, HIP 920 C, 2 hour, 1000 bar, grinding", "quench and temper 450 C and grinding", "machining 0.5 mm/side"]:
        cost = {tuple(v): b + sum(P._bits(x, known, total) for x in v) for b, v in parses(text)}
        best = P._best(text, known, total)
        assert sum(P._bits(x, known, total) for x in best) <= min(cost.values())
        assert all(P.shape(x) in known for x in best)


def test_marked_lists_are_weighed_like_other_dialects(spark, scratch):
    """A mark opens a list only if that is the shorter code; one-line bullets divide too."""
    found = run(spark, scratch, ["- grinding; chemical etching", "• grinding • chemical etching • grinding", "1) grinding; 2) chemical etching", "- grinding\n- chemical etching\n- grinding"])
    assert found[0][-1] == "chemical etching" and len(found[0]) == 2
    assert found[1] == ["grinding", "chemical etching", "grinding"]
    assert found[2] == ["grinding", "chemical etching"]
    assert found[3] == ["grinding", "chemical etching", "grinding"]


def test_many_kinds_of_separators(spark, scratch):
    signs = ["; ", " | ", " -> ", " / ", " + ", " & ", ", ", " · ", " - ", "  ", " and ", "\t"]
    text = "".join(TRAINING[1] + s for s in signs) + TRAINING[6]
    found = run(spark, scratch, [text])
    assert found[0] == [TRAINING[1]] * len(signs) + [TRAINING[6]]


def test_the_book_is_alike_at_every_size(spark, scratch):
    """Shapes enter the code book by their share; long ones are kept by a hash."""
    long = "laser peening with a very long description of everything that was done to the part before and after"
    for times in (1, 40):
        rows = [(f"{t}", 10 * times) for t in TRAINING] + [(long, 10 * times)]
        book, total = P._book(spark.createDataFrame([(P._key(P.shape(t)), n) for t, n in rows], "shape string, n long"))
        assert len(book) == 8 and total == 80 * times and all(len(k) < 70 for k in book)
