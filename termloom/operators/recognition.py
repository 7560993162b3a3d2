"""Recognised characters: joins, merges, labels, spaces, smoothing, classification and decoding.

Characters and boxes are rows of (page, line, ..., x, y, w, h); a line or a page is
the unit of order, and nothing here orders a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.operators.geometry import overlap_ratio

#: fixed values: stands for an unknown label; probability of an unseen pair of syllables; marks that end a syllable or a sentence
UNKNOWN, UNSEEN = "�", 1e-5
MARK, STOP = "་", "།"
#: fixed values: marks that end a run of sizes, those that close one, and those that open one
SIZE_ENDS, SIZE_CLOSES, SIZE_OPENS = "། ()〈〉༽༼༔༑", "། )〉༽༔༑", "(〈༼"


# boxes


def box_edges(prefix: str = "") -> list[Column]:
    """left, right, top, bottom, w, h of a box."""
    c = lambda n: F.col(prefix + n)
    return [c("x").alias("left"), (c("x") + c("w")).alias("right"), c("y").alias("top"), (c("y") + c("h")).alias("bottom"), c("w"), c("h")]


def scale_factor(width: Column, white: Column, most_transitions: Column) -> Column:
    """35 over the width a transition takes, without white columns; 1 without transitions."""
    return F.when(most_transitions > 0, 35.0 / ((width - white) / most_transitions)).otherwise(1.0)


def page_kind(width: Column, height: Column, page_type: Column, method: Column) -> tuple[Column, Column]:
    """(page type, line method): what is set stays; if neither is, the page's shape tells; clusters of lines are of long pages."""
    unset = page_type.isNull() & method.isNull()
    method = F.when(unset, F.when(width > 2 * height, "line_cluster").otherwise("line_cut")).otherwise(method)
    kind = F.when(unset, F.when(width > 2 * height, "pecha").otherwise("book")).otherwise(page_type)
    return F.when(method == "line_cluster", "pecha").otherwise(kind), method


def several_lines(pages: DataFrame, keys: list[str], spread: float = 50) -> DataFrame:
    """(keys, spread, several): whether a page's boxes lie over more than ``spread`` pixels of height."""
    return pages.groupBy(*keys).agg((F.max("y") - F.min("y")).alias("spread")).withColumn("several", F.col("spread") > spread)


def mark_width(w: Column, mean: Column, dev: Column) -> Column:
    """Whether a box is about as wide as a mark."""
    return w.between(mean - 3 * dev, mean + dev)


def header_rule(w: Column, y: Column, page_width: Column, page_height: Column) -> Column:
    """Whether a box is a rule over the page: nearly as wide as it and in its top quarter."""
    share = w / page_width
    return (share > 0.66) & (share < 0.995) & (y < page_height / 4)


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.77) -> DataFrame:
    """(keys, a, b) of intervals (id, lo, hi) of equal keys whose overlap is ``least`` of the shorter one or more."""
    left = a.select(*keys, F.col("id").alias("a"), F.col("lo").alias("l1"), F.col("hi").alias("h1"))
    right = b.select(*keys, F.col("id").alias("b"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    share = overlap_ratio(F.col("l1"), F.col("h1"), F.col("l2"), F.col("h2"))
    return left.join(right, keys).where((F.col("l1") < F.col("h2")) & (F.col("l2") < F.col("h1"))).where(share >= least).select(*keys, "a", "b")


def with_children(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, children): the outer shapes (no parent) and the shapes right inside them, one level."""
    inner = shapes.where("parent is not null").groupBy(*keys, F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(F.col("id"))).alias("children"))
    return shapes.where("parent is null").select(*keys, "id").join(inner, [*keys, "id"], "left").withColumn("children", F.coalesce("children", F.array()))


def nearest_line(points: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with the number of the line of equal keys whose mean y is nearest; the least number of equally near ones.

    A page's lines are one array: there are as many as lines on a page.
    """
    means = lines.groupBy(*keys, "line").agg(F.avg("y").alias("m")).groupBy(*keys).agg(F.collect_list(F.struct("m", "line")).alias("__lines"))
    near = F.array_min(F.transform("__lines", lambda s: F.struct(F.abs(s["m"] - F.col("y")).alias("d"), s["line"].alias("line"))))
    return points.join(means, keys, "left").withColumn("line", near["line"]).drop("__lines")


def nearest_within(points: DataFrame, known: DataFrame, keys: list[str], limit: float = 30.0) -> DataFrame:
    """``points`` (id, x, y) with the id of the nearest known point less than ``limit`` away, or null.

    Points meet known ones of the nine squares of a grid around them, so a page is never a cross join.
    """
    square = lambda c: F.floor(F.col(c) / limit).cast("long")
    around = points.withColumn("__gx", F.explode(F.array(*[square("x") + i for i in (-1, 0, 1)]))).withColumn("__gy", F.explode(F.array(*[square("y") + i for i in (-1, 0, 1)])))
    marks = known.select(*keys, F.col("id").alias("__known"), F.col("x").alias("__x"), F.col("y").alias("__y"), square("x").alias("__gx"), square("y").alias("__gy"))
    far = F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)
    met = around.join(marks, [*keys, "__gx", "__gy"]).withColumn("__d", far).where(F.col("__d") < limit)
    best = met.groupBy(*keys, "id").agg(F.min(F.struct("__d", "__known"))["__known"].alias("nearest"))
    return points.join(best, [*keys, "id"], "left")


def with_marks(chars: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, x, ch): marks put between the characters of their line by x; a mark stands after a character at its place."""
    both = chars.select(*keys, "x", "ch", F.lit(0).alias("__kind")).unionByName(marks.select(*keys, "x", "ch", F.lit(1).alias("__kind")))
    return both.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("x", "__kind", "ch"))).drop("__kind")


def paired(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th rows of both, by order, beside each other; what has no partner goes."""
    number = lambda df: df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return number(a).join(number(b).drop(order), [*keys, "__n"]).drop("__n")


def merge_low_ink(boxes: DataFrame, blobs: DataFrame, keys: list[str], slack: float = 15) -> DataFrame:
    """Boxes (id, x, y, w, h) that lie in one blob, up to ``slack`` pixels at its sides, as one box; the blob with the least id counts; others stay.

    (keys, part, x, y, w, h, n) with the least id of a box's members as ``part``.
    """
    b = blobs.select(*keys, F.col("id").alias("__blob"), F.col("x").alias("__x"), (F.col("x") + F.col("w")).alias("__r"))
    inside = (F.col("x") >= F.col("__x") - slack) & (F.col("x") + F.col("w") <= F.col("__r") + slack)
    held = boxes.join(b, keys).where(inside).groupBy(*keys, "id").agg(F.min("__blob").alias("__blob"))
    own = boxes.join(held, [*keys, "id"], "left").withColumn("__own", F.when(F.col("__blob").isNull(), F.col("id")))
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return own.groupBy(*keys, "__blob", "__own").agg(F.min("id").alias("part"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"), F.count(F.lit(1)).alias("n")).drop("__blob", "__own")


# text


def with_spaces(chars: DataFrame, keys: list[str], mark_mean: float) -> DataFrame:
    """(keys, place, x, y, w, h, ch): characters with a space row (-1) where the gap to the next is two marks, four fifths of a character, or half a mark and three pixels wide."""
    w = W.partitionBy(*keys).orderBy("x", "y", "w", "h", "ch")
    gap = F.lead("x").over(w) - F.col("x") - F.col("w")
    wide = (gap >= 2 * mark_mean) | (gap >= 0.4 * (F.col("w") + F.lead("w").over(w))) | ((gap >= 0.5 * mark_mean) & (gap >= 3))
    own = chars.withColumn("__wide", F.coalesce(wide, F.lit(False))).withColumn("place", F.row_number().over(w))
    row = F.struct(F.lit(0).alias("k"), *[F.col(c).cast("double").alias(c) for c in "xywh"], F.col("ch"))
    space = F.struct(F.lit(1).alias("k"), *[F.lit(-1.0).alias(c) for c in "xywh"], F.lit(" ").alias("ch"))
    rows = own.select(*keys, "place", F.explode(F.when(F.col("__wide"), F.array(row, space)).otherwise(F.array(row))).alias("r"))
    return rows.select(*keys, (F.col("place") * 2 + F.col("r.k")).cast("long").alias("place"), *[F.col(f"r.{c}").alias(c) for c in "xywh"], F.col("r.ch").alias("ch"))


def lines_by_height(chars: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, line, y, place): a page's lines from top to bottom by the mean y of their characters; space rows don't count, lines without any come last."""
    means = chars.groupBy(*keys, line).agg(F.avg(F.when(F.col("y") >= 0, F.col("y"))).alias("y"))
    return means.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("y").asc_nulls_last(), line)))


def page_text(chars: DataFrame, keys: list[str], gap: float = 39.0) -> DataFrame:
    """(keys, text) of characters (line, x, r, ch) in order: a new line where the line's number rises by one, else a space where the gap is wide."""
    w = W.partitionBy(*keys).orderBy("line", "x", "r", "ch")
    after = F.when(F.lead("line").over(w) == F.col("line") + 1, "\n").when(F.lead("x").over(w) - F.col("r") >= gap, " ").otherwise("")
    own = chars.withColumn("__t", F.concat("ch", after))
    return own.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x", "r", "ch", "__t"))), lambda s: s["__t"]), "").alias("text"))


def run_without(keys: list[str], order: str, is_mark: Column) -> Column:
    """How many rows stand since the last mark, this one included; 0 at a mark."""
    w = W.partitionBy(*keys).orderBy(order)
    last = F.last(F.when(is_mark, F.row_number().over(w)), True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.row_number().over(w) - F.coalesce(last, F.lit(0))


def smoothed_sizes(chars: DataFrame, keys: list[str], order: str, segments: bool = True) -> DataFrame:
    """``chars`` (ch) with ``smooth``: the size (``s`` or ``b``) that most of its run has, or on a tie most of the group.

    ``ch`` is a size, or a mark: closing marks end a run and belong to it, opening
    ones begin the next.  Without ``segments`` the group is one run.
    """
    w = W.partitionBy(*keys).orderBy(order)
    one_of = lambda marks: F.col("ch").isin([*marks])
    own = chars.withColumn("__end", one_of(SIZE_CLOSES).cast("int")).withColumn("__begin", one_of(SIZE_OPENS).cast("int"))
    before = F.coalesce(F.sum("__end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = before + F.sum("__begin").over(w.rowsBetween(W.unboundedPreceding, 0)) if segments else F.lit(0)
    own = own.withColumn("__run", run)
    n = lambda size, part: F.sum((F.col("ch") == size).cast("int")).over(part)
    inner, whole = W.partitionBy(*keys, "__run"), W.partitionBy(*keys)
    mode = F.when(n("b", whole) > n("s", whole), "b").otherwise("s")
    smooth = F.when(n("s", inner) > n("b", inner), "s").when(n("b", inner) > n("s", inner), "b").otherwise(mode)
    return own.withColumn("smooth", smooth).drop("__end", "__begin", "__run")


def marked_up(chars: DataFrame, keys: list[str], line: str, order: str, mode: str, tag: str = '<span class="format_size">') -> DataFrame:
    """(keys, line, html): characters (ch, size) of each line with a tag around runs whose size is not ``mode``.

    A run that lasts over a line's end is closed there and opened again on the next line.
    """
    w = W.partitionBy(*keys, line).orderBy(order)
    other = F.col("size") != mode
    opens = other & ~F.coalesce(F.lag("size").over(w) != mode, F.lit(False))
    closes = other & ~F.coalesce(F.lead("size").over(w) != mode, F.lit(False))
    own = chars.withColumn("__t", F.concat(F.when(opens, tag).otherwise(""), "ch", F.when(closes, "</span>").otherwise("")))
    return own.groupBy(*keys, line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__t"))), lambda s: s["__t"]), "").alias("html"))


# labels, classes and paths


def labelled(predictions: DataFrame, labels: DataFrame, index: str = "idx") -> DataFrame:
    """``predictions`` with the label (ch) of their index, else that of the greatest index below, else UNKNOWN.

    The labels are spread over the gaps between their indices, so that the join is one of equal keys; there are as many rows as the greatest index.
    """
    w = W.orderBy("idx")  # the labels of a model
    spread = labels.select("idx", "ch", F.coalesce(F.lead("idx").over(w) - 1, F.col("idx")).alias("__to")).select("ch", F.explode(F.sequence("idx", "__to")).alias("__i"))
    most = labels.agg(F.max("idx").alias("__most"))
    own = predictions.crossJoin(F.broadcast(most)).withColumn("__i", F.least(F.col(index), "__most"))  # one row
    return own.join(spread, "__i", "left").withColumn("ch", F.coalesce("ch", F.lit(UNKNOWN))).drop("__i", "__most")


def checked_model(table: DataFrame, least: int, name: str) -> DataFrame:
    """A model's table, if it has as many rows as a whole one must have; fails loudly else."""
    n = table.limit(least).count()
    if n < least:
        raise ValueError(f"{name} has {n} rows, at least {least} are needed")
    return table


def train_classifier(rows: DataFrame, features: str = "vec", label: str = "label", penalty: float = 1e-3, rounds: int = 100):
    """A multinomial logistic regression over standardised features, distributed by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("__x"), F.col(label).cast("double").alias("__y"))
    return LogisticRegression(featuresCol="__x", labelCol="__y", regParam=penalty, maxIter=rounds, family="multinomial").fit(data)


def classified(rows: DataFrame, model, features: str = "vec") -> DataFrame:
    """``rows`` with ``idx`` and ``prob`` of the likeliest class, and ``top``, the three likeliest as (idx, prob)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(rows.withColumn("__x", array_to_vector(F.col(features).cast("array<double>"))))
    p = vector_to_array("probability")
    ranked = F.slice(F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("p"), i.alias("i")))), 1, 3)
    out = scored.withColumn("__top", ranked)
    top = F.transform("__top", lambda s: F.struct(s["i"].alias("idx"), (-s["p"]).alias("prob")))
    return out.select(*rows.columns, F.get("__top", F.lit(0))["i"].alias("idx"), (-F.get("__top", F.lit(0))["p"]).alias("prob"), top.alias("top"))


def softmax(scores: Column) -> Column:
    """Shares of an array of scores."""
    grown = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(grown, lambda g: g / F.aggregate(grown, F.lit(0.0), lambda a, x: a + x))


def beam(states: DataFrame, keys: list[str], score: str, most: int = 50, *ties: str) -> DataFrame:
    """The ``most`` best rows of each step."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), *ties))
    return states.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def likeliest_reading(choices: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, choice, p): of readings (choice, syllables) the one whose pairs of syllables are likeliest together.

    ``pairs`` is (a, b, p); a pair that is not in it has UNSEEN.  The least choice number wins a tie.
    """
    n = F.size("syllables")
    steps = choices.select(*keys, "choice", F.explode_outer(F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.get("syllables", i - 1).alias("a"), F.get("syllables", i).alias("b"))))).alias("s"))
    met = steps.select(*keys, "choice", "s.a", "s.b").join(pairs, ["a", "b"], "left")
    p = F.when(F.col("a").isNull(), 1.0).otherwise(F.coalesce("p", F.lit(UNSEEN)))
    whole = met.groupBy(*keys, "choice").agg(F.exp(F.sum(F.log(p))).alias("p"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("p", 15)), "choice"))
    return whole.withColumn("__r", best).where("__r = 1").drop("__r")


def hidden_marks(emissions: DataFrame, start: dict[int, float], steps: dict[tuple[int, int], float], triples: dict[tuple[int, int], float], mark: int, most: int = 50) -> DataFrame:
    """(seq, states): the likeliest states of each sequence (seq, t, state, p) with marks between them where they are likely.

    Between two letters the best path so far may take a mark: the step to it counts
    ``triples`` of the path's last two letters (one half if unseen) times one and twice the
    number of letters since its last mark, or three quarters for a first letter.  A
    letter follows the better of the path with and the path without the mark.  Only the
    ``most`` likeliest letters of a step are followed.
    """
    import pandas as pd

    letters = sorted({*start, *(s for pair in steps for s in pair)})

    def marked(paths: dict) -> tuple[float, tuple] | None:
        found = None
        for state in letters:
            if state not in paths:
                continue
            p, path = paths[state]
            run = next((i for i, s in enumerate(reversed(path)) if s == mark), len(path))
            third = triples.get(path[-2:], 0.5) * (1 + 2 * run) if len(path) > 1 else 0.75
            step = (p * steps.get((state, mark), 0.0) * third, state, path)
            found = max(found, step) if found else step
        return (found[0], (*found[2], mark)) if found else None

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen = {t: dict(zip(g["state"], g["p"])) for t, g in group.groupby("t")}
        first, *rest = sorted(seen)
        paths = {s: (start[s] * seen[first].get(s, 0.0), (s,)) for s in letters if s in start}
        for t in rest:
            with_mark, after = marked(paths), {}
            for y in sorted(seen[t], key=lambda s: (seen[t][s], s))[-most:]:
                ways = [(p * steps.get((s, y), 0.0) * seen[t][y], s) for s, (p, _) in paths.items() if p]
                if not ways:
                    continue
                p, s = max(ways)
                path = paths[s][1]
                if with_mark:
                    q = with_mark[0] * steps.get((mark, y), 0.0) * seen[t][y]
                    if q > p:
                        p, path = q, with_mark[1]
                after[y] = (p, (*path, y))
            paths = after
        best = max(((p, s) for s, (p, _) in paths.items()), default=None)
        return pd.DataFrame({"seq": [group["seq"].iloc[0]], "states": [list(paths[best[1]][1]) if best else []]})

    return emissions.groupBy("seq").applyInPandas(run, "seq long, states array<long>")


def box_tree(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, parent): of boxes (id, x, y, w, h) the one around each that begins farthest right, or null; of equal ones the least id.

    Different boxes of a page have different ids.  Equal boxes are compared with others
    once, as the one with the least id, which is around its equals; so pairs grow with a
    page's different boxes.  Of pairs only a least id for each outer x stays, which needs no sort.
    """
    box = [*keys, *"xywh"]
    first = boxes.where("id is not null").groupBy(*box).agg(F.min("id").alias("__first"))
    other = first.select(*[F.col(c).alias(f"__{c}") for c in box], F.col("__first").alias("__outer"))
    around = (F.col("__x") <= F.col("x")) & (F.col("__y") <= F.col("y")) & (F.col("__x") + F.col("__w") >= F.col("x") + F.col("w")) & (F.col("__y") + F.col("__h") >= F.col("y") + F.col("h"))
    equal = F.lit(True)
    for c in "xywh":
        equal = equal & (F.col(c) == F.col(f"__{c}"))
    for k in keys:
        around = (F.col(k) == F.col(f"__{k}")) & around
    pairs = first.join(other, around & ~equal, "left").groupBy(*box, "__first", "__x").agg(F.min("__outer").alias("__outer"))
    outer = pairs.groupBy(*box, "__first").agg(F.max("__x").alias("__x"), F.max_by("__outer", "__x").alias("__outer"))
    own = boxes.select(*box, "id").join(outer, box, "left")
    equals = F.least("__first", F.when(F.col("__x") == F.col("x"), F.col("__outer")))
    return own.select(*keys, "id", F.when(F.col("id") == F.col("__first"), F.col("__outer")).when(F.col("id") > F.col("__first"), equals).alias("parent"))


def sized(chars: DataFrame, stack: str, width: str) -> DataFrame:
    """(stack, width, size) for each width of each stack: ``b`` or ``s``, by which of two Gaussians over the stack's widths it is likelier of.

    The widths are counted first, so a stack's group has a row for each width.
    """
    import numpy as np
    import pandas as pd

    from termloom.operators.vision import mixture

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, n = group[width].to_numpy(float), group["count"].to_numpy(float)
        weight, mean, dev = mixture(x, n)
        log = np.log(weight) - np.log(dev) - 0.5 * ((x[:, None] - mean) / dev) ** 2
        large = log.argmax(1) == int(mean.argmax())
        return pd.DataFrame({stack: group[stack], width: group[width], "size": np.where(large & (len(x) > 1), "b", "s")})

    counted = chars.groupBy(stack, width).count()
    return counted.groupBy(stack).applyInPandas(run, chars.select(stack, width, F.lit("").alias("size")).schema)


def small_mark(w: Column, h: Column, y: Column, least: int = 3, most: int = 6, area: tuple[int, int] = (9, 25), rows: tuple[int, int] = (5, 35)) -> Column:
    """Whether a box has the size of a mark between syllables and stands in the rows of the text."""
    return w.between(least, most) & h.between(least, most) & (w * h).between(*area) & y.between(*rows)


def outer_pieces(boxes: DataFrame, keys: list[str], page_width: Column, several: Column, few: int = 40) -> DataFrame:
    """The boxes (id, parent, x, y, w, h) that may be characters.

    Those inside the parent that most boxes of their page have (the least of equally
    frequent ones), unless they are a tenth of the page wide on a page of ``few`` boxes or more.  On pages of
    several lines others too, if a quarter of the median area and three tenths of the
    lesser median side are reached and they are no flat fragments.
    """
    count = boxes.groupBy(*keys, "parent").agg(F.count(F.lit(1)).alias("__c"))
    pages = count.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.min(F.struct((-F.col("__c")).alias("c"), F.col("parent").alias("p")))["p"].alias("__parent"))
    medians = boxes.groupBy(*keys).agg(F.median("w").alias("__w"), F.median("h").alias("__h"), F.median(F.col("w") * F.col("h")).alias("__a"))
    own = boxes.join(pages.join(medians, keys), keys)
    known = F.col("__n") > 6
    area = F.when(known, F.greatest(F.lit(10), F.floor(F.col("__a") * 0.25))).otherwise(15)
    side = F.when(known, F.greatest(F.lit(3), F.floor(F.least("__w", "__h") * 0.3))).otherwise(4)
    flat = F.when(known, F.greatest(F.lit(8), F.floor(F.col("__h") * 0.4))).otherwise(10)
    w, h = F.col("w"), F.col("h")
    fits = (w < 0.1 * page_width) | (F.col("__n") < few)
    large = (w * h >= area) & (w >= side) & (h >= side) & ~((h < flat) & (w > 1.4 * h))
    return own.where(fits & (F.col("parent").eqNullSafe(F.col("__parent")) | (several & large))).select(*boxes.columns)
