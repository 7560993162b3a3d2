"""What the catalogue's operators once left out, against brute force."""

import collections
import itertools
import random

from termloom.operators import layout, lines, recognition
from termloom.plans import more_queries


def test_white_columns_of_whole_lines(spark):
    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choice("ab \t") for _ in range(rng.randrange(200))) for _ in range(5)) for _ in range(20)]
    want = collections.Counter(i for t in texts for line in t.split("\n") for i, ch in enumerate(line) if ch.isspace())
    got = layout.white_columns(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {r.position: r.n for r in got} == want and max(want) > 40


def test_pages_are_not_broadcast(spark):
    """Numbers of a page's rows and columns are as many as its places, though the input that they come from seems small."""
    places = spark.range(60).selectExpr("id % 3 AS page", "'w' AS text", "id DIV 3 * 31.0D AS x", "id DIV 3 * 4.0D AS y")
    placed = lines.placed_rows(places, ["page"])
    assert "BroadcastExchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page, r.row, r.column) for r in placed.collect()) == [(page, k, k) for page in range(3) for k in range(20)]


def test_boxes_around_equal_ones(spark):
    """Equal boxes, repeated rows and nulls against brute force; pairs of boxes are not sorted before they are summed."""
    rng = random.Random(4)
    shape = lambda: (rng.randrange(4), rng.randrange(3), rng.randrange(1, 5), rng.randrange(1, 4))
    boxes = [(rng.randrange(3), k, *shape()) for k in range(400)]
    boxes += [*boxes[:20], (None, 900, 0, 0, 9, 9), (1, None, 0, 0, 9, 9), (1, 901, None, 0, 9, 9), (2, -1, 0, 0, 9, 9)]
    inside = lambda a, b: None not in (*a, *b) and b[0] == a[0] and b[1] != a[1] and b[2] <= a[2] and b[3] <= a[3] and b[2] + b[4] >= a[2] + a[4] and b[3] + b[5] >= a[3] + a[5] and (b[2:] != a[2:] or b[1] < a[1])
    want = [(a[0], a[1], min(((-b[2], b[1]) for b in boxes if inside(a, b)), default=(0, None))[1]) for a in boxes]
    tree = recognition.box_tree(spark.createDataFrame(boxes, "page long, id long, x int, y int, w int, h int"), ["page"])
    assert "SortAggregate" not in tree._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, tree.collect()), key=key) == sorted(want, key=key)


def test_reading_order_at_one_point(spark):
    """Events whose numbers differ by 211 * 997 are at one point; they come by their numbers, whatever the order of rows."""
    events = [(k + i * 211 * 997, 50 * k) for k in range(30) for i in range(5)]
    for rows in (events, events[::-1], random.Random(5).sample(events, len(events))):
        got = more_queries.q_reading_order(lambda _: spark.createDataFrame(rows, "event_id long, user_id long")).collect()  # noqa: B023
        at = lambda r: (r.id * 37 % 211 // 50, r.id * 53 % 997, r.id * 37 % 211, r.id)
        assert [r.place for r in sorted(got, key=at)] == list(range(1, 151))


def test_spaces_after_equal_words(spark):
    """Of equal words at one place the widest is last, whatever the order of rows, and the next gap begins where it ends."""
    words = [(1, 0, 10, "a"), (1, 130, 20, "b"), (1, 130, 60, "b"), (1, 130, -15, "b"), (1, 205, 5, "c")]
    for rows in list(itertools.permutations(words))[::17]:
        got = layout.spaced_line(spark.createDataFrame(rows, "line long, left int, width int, text string"), ["line"])
        assert [tuple(r) for r in got.collect()] == [(1, "a    b bb c")]
