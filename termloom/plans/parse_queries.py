"""Queries of the line parsers over crafted lines, and the SQL that says the same.

The common tables hold no Tibetan text, so each part gets a line from LINES by its
key, with its name put in.  SQL has no look-ahead in its patterns and no rules as
data; ``Sql`` writes them out as expressions of its own.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import functions as F

from termloom.functions import parse as P
from termloom.functions import spelling as S
from termloom.operators import lines as L
from termloom.plans.catalogue import query

LINES = [
    "{} factor bot སྐྱེ་ལྡན་མིན་པའི་ རྐྱེན། གཞན་གྱི་དོན་གསལ་བ།", "acc. {} Accountancy ཚད་རིགས།", "table com, econ Garbled12 text {}", "{}", "minded {} psycho སེམས་ ཡེངས་ པ། དོན་ གཞན་ ལ་ སེམས་ ཡེངས་པའི་ གནས་ཚུལ།",
    "ཀུན་ནས", "༡༢", " 12 ", "{} econ,adm རྩིས་ཁྲ། གྲངས་རྩིས་ བྱེད་པའི་ ལག་ཆ།  x", "able to {} ལྟ་ཐུབ་པ།", "a", "{}    phil    ནུས་པ།    བྱེད་ནུས།", "Page {} 7", "{} med   སྨན་གྱི་ནུས་པ་ བསྐྱེད་བྱེད་ཀྱི་ རྐྱེན། ནད་སེལ།",
    "continued {} text", "སྐྱེ་དངོས་ཀྱིས་ སྐྱེད་པའམ་ སྐྱེ་དངོས་ནས་ བྱུང་བའི་ རྫས་ཤིག་ལ་ གོ།", "མདོ་སྡེ་ {} དང་  འདུལ་བ།", "་་ ། ", "absolute pressure {} 44", "x {} bio སྲོག་ཆགས་་་མང་པོ་ཡོད་པའི་ས་ཆ་ཞིག་གི་མིང་སྟེ་རྒྱ་ཆེན་པོ་ཡོད་པའི་ཡུལ་ལུང་ཞིག་རེད་ཟེར",
    "{} geo ས་ཆ། རི།", "Glossary", "the {} of chem གཅིག་ གཉིས་ གསུམ་ བཞི་ ལྔ་ དྲུག་ བདུན་ བརྒྱད་", "{} hist རྒྱལ་རབས་ ལོ་རྒྱུས། sea",
]
_c = F.col


def _line():
    return F.replace(F.element_at(F.array(*[F.lit(x) for x in LINES]), (_c("p_partkey") % len(LINES) + 1).cast("int")), F.lit("{}"), F.substring_index("p_name", " ", 1))


def _lines(t):
    return t("part").select("p_partkey", _line().alias("line"))


def _pages(t):
    """Seven lines each."""
    at = F.array_sort(F.collect_list(F.struct("p_partkey", "line")))
    return _lines(t).groupBy(F.floor(_c("p_partkey") / 7).cast("long").alias("page")).agg(F.array_join(F.transform(at, lambda x: x["line"]), "\n").alias("text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SQL_LINES = f"lines AS (SELECT p_partkey, replace([{', '.join(map(_q, LINES))}][CAST(p_partkey % {len(LINES)} AS INTEGER) + 1], '{{}}', split_part(p_name, ' ', 1)) AS line FROM part)"
_SQL_PAGES = _SQL_LINES + ", pages7 AS (SELECT p_partkey // 7 AS page, string_agg(line, chr(10) ORDER BY p_partkey) AS text FROM lines GROUP BY 1)"


class Sql:
    """SQL expressions of the parsers."""

    number = count()

    @classmethod
    def let(cls, value: str, body) -> str:
        name = f"v{next(cls.number)}"
        return f"list_transform([{value}], lambda {name}: {body(name)})[1]"

    @staticmethod
    def strip(c: str) -> str:
        return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"

    @classmethod
    def squeeze(cls, c: str) -> str:
        return cls.strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")

    @classmethod
    def words(cls, c: str) -> str:
        return rf"regexp_split_to_array({cls.strip(c)}, '\s+')"

    @staticmethod
    def spaced(x: str, first: str, n: str) -> str:
        return f"array_to_string({x}[{first}:({first}) + ({n}) - 1], ' ')"

    @staticmethod
    def pair(term: str, definition: str) -> str:
        return f"{{'term': {term}, 'definition': {definition}}}"

    @staticmethod
    def has(c: str, pattern: str) -> str:
        return f"regexp_matches({c}, {_q(pattern)})"

    @classmethod
    def full(cls, c: str, pattern: str) -> str:
        return f"regexp_full_match({c}, {_q(pattern)})"

    @staticmethod
    def group(c: str, pattern: str, i: int) -> str:
        return f"regexp_extract({c}, {_q(pattern)}, {i})"

    @classmethod
    def english_column(cls, c: str) -> str:
        return cls.squeeze(rf"regexp_replace(regexp_replace(regexp_replace({c}, '\s+x\s*$', ''), '\s+[0-9]+\s*$', ''), '[^a-zA-Z\s''-]', ' ', 'g')")

    @classmethod
    def english(cls, c: str) -> str:
        return rf"lower(regexp_replace({cls.squeeze(c)}, '^[^a-zA-Z]+|[^a-zA-Z\s''-]+$', '', 'g'))"

    @classmethod
    def tibetan(cls, c: str) -> str:
        return cls.strip(f"regexp_replace({cls.squeeze(c)}, '།{{2,}}$', '།')")

    @classmethod
    def split(cls, c: str, rules: tuple) -> str:
        ways = lambda t: ", ".join([*[cls.rule(t, r) for r in rules], cls.pair(t, "''")])
        return cls.let(cls.strip(f"coalesce({c}, '')"), lambda t: f"coalesce({ways(t)})")

    @classmethod
    def rule(cls, t: str, r) -> str:
        if isinstance(r, P.Completed):
            return cls.completed(t, r)
        if isinstance(r, P.AtMark):
            ends = [f"CASE WHEN strpos({t}, {_q(m)}) - 1 > {r.after} AND strpos({t}, {_q(m)}) - 1 < length({t}) - {r.before_end} THEN strpos({t}, {_q(m)}) - 1 + {len(m)} END" for m in r.marks]
            if r.earliest:
                ends = [f"least({', '.join(ends)})"]
            cut = lambda e: cls.let(cls.pair(cls.strip(f"left({t}, {e})"), cls.strip(f"substr({t}, {e} + 1)")), lambda p: f"CASE WHEN length({p}.term) BETWEEN {r.term[0]} AND {r.term[1]} AND length({p}.definition) >= {r.definition} THEN {p} END")
            return f"coalesce({', '.join(cls.let(e, lambda x: f'CASE WHEN {x} IS NOT NULL THEN {cut(x)} END') for e in ends)})"
        if isinstance(r, P.AtSpaces):
            whole = lambda x: cls.let(cls.pair(cls.strip(f"{x}[1]"), f"array_to_string({x}[2:], ' ')"), lambda p: f"CASE WHEN len({x}) >= 2 AND length({p}.term) >= {r.each} AND length({p}.definition) >= {r.each} THEN {p} END")
            return cls.let(rf"regexp_split_to_array({t}, '\s{{{r.least},}}')", whole)
        return cls.let(cls.words(t), lambda w: f"CASE WHEN len({w}) >= {r.least} THEN {cls.let(cls.cut(w, r), lambda n: cls.pair(cls.spaced(w, '1', n), f'array_to_string({w}[{n} + 1:], {_q(chr(32))})'))} END")

    @classmethod
    def cut(cls, w: str, r) -> str:
        n = f"least({r.most}, len({w}) // {r.share})" if r.share else str(r.most)
        for i in range(r.upto, r.most - 1, -1):
            n = f"CASE WHEN len({w}) >= {i} AND ({' OR '.join(f'suffix({w}[{i}], {_q(e)})' for e in r.ends)}) THEN {i} ELSE {n} END"
        return n

    @classmethod
    def completed(cls, t: str, r) -> str:
        mark = _q(P.COMPLETION)
        before, after = f"split_part({t}, {mark}, 1)", f"substr({t}, strpos({t}, {mark}) + {len(P.COMPLETION)})"
        asks = lambda w: "(" + " OR ".join([*([cls.has(w, r.asking)] if r.asking else []), *([f"contains({w}, {_q(r.holding)})"] if r.holding else [])]) + ")"
        if r.whole:
            way = cls.let(cls.pair(cls.strip(f"{before} || {mark}"), cls.strip(after)), lambda p: f"CASE WHEN length({p}.term) >= {r.term} AND length({p}.definition) >= {r.definition} THEN {p} END")
        elif r.near:
            asked = lambda w: cls.pair(f"{w}[-2] || {mark}", cls.strip(f"{cls.spaced(w, '1', f'len({w}) - 2')} || ' ' || {w}[-1] || ' ' || {after}"))
            plain = lambda w: cls.pair(f"{w}[-1] || {mark}", cls.strip(f"{cls.spaced(w, '1', f'len({w}) - 1')} || ' ' || {after}"))
            way = cls.let(cls.words(before), lambda w: f"CASE WHEN len({w}) >= 2 THEN CASE WHEN {asks(f'{w}[-2]')} THEN {asked(w)} ELSE {plain(w)} END END")
        else:
            last = lambda w: f"coalesce(list_max(list_transform(range(1, len({w}) + 1), lambda i: CASE WHEN {asks(f'{w}[i]')} THEN i END)), {f'len({w})' if r.fallback else '0'})"
            kept = lambda w, k: cls.strip(f"(CASE WHEN {k} > 1 THEN {cls.spaced(w, '1', f'{k} - 1')} || ' ' ELSE '' END) || {cls.strip(after)}")
            made = lambda w, k: f"CASE WHEN {k} > 0 THEN {cls.pair(f'{w}[{k}] || {mark}', kept(w, k))} END"
            way = cls.let(cls.words(before), lambda w: cls.let(last(w), lambda k: made(w, k)))
        return f"CASE WHEN strpos({t}, {mark}) > {r.first} THEN {way} END"

    @classmethod
    def entry(cls, english: str, subject: str, pair: str) -> str:
        return cls.let(pair, lambda p: f"{{'english': {english}, 'subject': {subject}, 'term': {p}.term, 'definition': {p}.definition}}")

    @classmethod
    def by_position(cls, t: str) -> str:
        """The split of a fixed-width line's last columns."""
        head = f"left({t}, 25)"
        last = lambda m: f"CASE WHEN contains({head}, {_q(m)}) THEN length({head}) - strpos(reverse({head}), {_q(m)}) END"
        near = [f"CASE WHEN suffix({head}, {_q(P.COMPLETION)}) THEN 25 END", *[f"CASE WHEN {last(m)} > 15 THEN {last(m)} + 1 END" for m in P.MARKS[:3]], f"CASE WHEN {last(' ')} > 17 THEN {last(' ')} END"]
        cut = f"CASE WHEN length({t}) > 25 THEN coalesce({', '.join(near)}) END"
        return f"coalesce({cls.let(cut, lambda n: f'CASE WHEN {n} > 0 THEN {cls.pair(cls.strip(f'left({t}, {n})'), cls.strip(f'substr({t}, {n} + 1)'))} END')}, {cls.split(t, P.SMART_RULES)})"

    @classmethod
    def english_word(cls, w: str) -> str:
        return f"length(regexp_replace({w}, '[^a-zA-Z''-]', '', 'g')) >= 2"

    @classmethod
    def leading(cls, w: str) -> str:
        return f"coalesce(list_min(list_transform(range(1, len({w}) + 1), lambda i: CASE WHEN NOT ({cls.english_word(f'{w}[i]')}) THEN i END)), len({w}) + 1) - 1"

    @classmethod
    def valid(cls, way: str) -> str:
        e = lambda w: f"length({w}.english) BETWEEN 2 AND 100 AND length({cls.strip(f'{w}.english')}) >= 2 AND length({cls.strip(f'{w}.term')}) >= 2 AND {cls.has(f'{w}.term', '[ༀ-࿿]')} AND {cls.full(f'{w}.english', P.ENGLISH)}"
        return cls.let(way, lambda w: f"CASE WHEN {w} IS NOT NULL AND {e(w)} THEN {w} END")

    @classmethod
    def way_pattern(cls, line: str) -> str:
        ahead = lambda t: cls.group(t, r"^([a-zA-Z][a-zA-Z\s'-]*?)(?:\s+[a-z]{2,6}\s|\s+[ༀ-࿿])", 1)
        lead = lambda t: cls.let(rf"regexp_split_to_array({t}, '\s+')", lambda w: cls.spaced(w, "1", cls.leading(w)))
        english = lambda t: cls.let(ahead(t), lambda a: f"CASE WHEN {a} <> '' THEN {cls.english_column(a)} ELSE {lead(t)} END")
        chain = lambda b: cls.split(cls.squeeze(rf"regexp_replace({b}, '\s+x\s*$', '')"), P.CHAIN_RULES)
        body = lambda e, rest, s: cls.let(cls.strip(f"substr({rest}, length({s}) + 1)"), lambda b: f"CASE WHEN {e} <> '' AND {s} <> '' AND {cls.has(b, '[ༀ-࿿]')} THEN {cls.entry(e, s, chain(b))} END")
        subject = lambda rest: cls.group(rest, rf"^({P.SUBJECTS})(?:\s|$)", 1)
        found = lambda t, e: cls.let(cls.strip(f"substr({t}, length({e}) + 1)"), lambda rest: cls.let(subject(rest), lambda s: body(e, rest, s)))
        return cls.let(cls.strip(rf"regexp_replace({line}, '\s+x\s*$', '')"), lambda t: cls.let(english(t), lambda e: found(t, e)))

    @classmethod
    def way_words(cls, line: str) -> str:
        code = lambda w, n: f"CASE WHEN {n} > 0 AND {n} < len({w}) AND {cls.full(f'{w}[{n} + 1]', P.SUBJECT)} THEN {w}[{n} + 1] ELSE '' END"
        start = lambda w, k: f"list_min(list_transform(range({k}, len({w}) + 1), lambda i: CASE WHEN {cls.has(f'{w}[i]', '[ༀ-࿿]')} THEN i END))"
        body = lambda w, n, s, k: f"CASE WHEN {n} > 0 AND {k} IS NOT NULL THEN {cls.entry(cls.english_column(cls.spaced(w, '1', n)), s, cls.split(f'array_to_string({w}[{k}:], {_q(chr(32))})', P.SMART_RULES))} END"
        rest = lambda w, n, s: cls.let(start(w, f"{n} + 1 + CASE WHEN {s} <> '' THEN 1 ELSE 0 END"), lambda k: body(w, n, s, k))
        return cls.let(rf"regexp_split_to_array({line}, '\s+')", lambda w: cls.let(cls.leading(w), lambda n: cls.let(code(w, n), lambda s: rest(w, n, s))))

    @classmethod
    def way_whole(cls, line: str) -> str:
        with_subject = rf"^([a-zA-Z][a-zA-Z\s'-]+?)\s+({P.SUBJECT})\s+([ༀ-࿿][\sༀ-࿿\x20-\x7F]*)$"
        without = r"^([a-zA-Z][a-zA-Z\s'-]+?)\s+([ༀ-࿿][\sༀ-࿿\x20-\x7F]*)$"
        g = cls.group
        first = f"CASE WHEN {cls.has(line, with_subject)} THEN {cls.entry(cls.english_column(g(line, with_subject, 1)), g(line, with_subject, 2), cls.split(g(line, with_subject, 3), P.SMART_RULES))} END"
        second = f"CASE WHEN {cls.has(line, without)} THEN {cls.entry(cls.english_column(g(line, without, 1)), _q(''), cls.split(g(line, without, 2), P.SMART_RULES))} END"
        return f"coalesce({first}, {second})"

    @classmethod
    def detected(cls, line: str) -> str:
        return cls.let(cls.strip(line), lambda t: f"CASE WHEN length({t}) >= 10 THEN coalesce({', '.join(cls.valid(way(t)) for way in (cls.way_pattern, cls.way_words, cls.way_whole))}) END")

    @classmethod
    def boundaries(cls, line: str) -> str:
        known = r"(?s)^(.*?) ([a-z]{2,6}|[a-z]+,[a-z]+)(?: |$)"
        first, size = f"length({cls.group(line, known, 1)})", f"length({cls.group(line, known, 2)})"
        head = cls.group(line, "(?s)^([^ༀ-࿿]*)[ༀ-࿿]", 1)
        blanks = f"list_filter(range(0, length({line})), lambda i: substr({line}, i + 1, 1) = ' ' AND (i = 0 OR substr({line}, i, 1) <> ' ') AND trim(substr({line}, i + 1), ' ') <> '')"
        return f"CASE WHEN {size} > 0 THEN list_filter([{first}, {first} + 1 + {size}], lambda x: x < length({line})) WHEN contains({head}, ' ') THEN [length({head}) - strpos(reverse({head}), ' ')] ELSE {blanks} END"

    @classmethod
    def parsed(cls, line: str) -> str:
        piece = lambda t, at, i, j: cls.strip(f"substr({t}, {at}[{i}] + 1, {at}[{j}] - {at}[{i}])")
        rest = lambda t, at, i: f"substr({t}, {at}[{i}] + 1)"
        pair = lambda t, at: f"CASE WHEN len({at}) >= 3 THEN {cls.pair(piece(t, at, 2, 3), cls.strip(rest(t, at, 3)))} WHEN len({at}) = 2 THEN {cls.split(rest(t, at, 2), P.LINE_RULES)} ELSE {cls.pair(_q(''), _q(''))} END"
        whole = lambda t, at: cls.entry(f"CASE WHEN len({at}) >= 1 THEN {cls.strip(f'left({t}, {at}[1])')} ELSE '' END", f"CASE WHEN len({at}) >= 2 THEN {piece(t, at, 1, 2)} ELSE '' END", pair(t, at))
        return cls.let(cls.strip(line), lambda t: cls.let(cls.boundaries(t), lambda at: whole(t, at)))


_STRUCT = "p.english AS english, p.subject AS subject, p.term AS term, p.definition AS definition"


def _cleaners():
    s = Sql
    page = s.strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\d+\s*$', '', 'g'), '[─━═-]{{3,}}', '', 'g'), '\s{{3,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
    entry = rf"lower(regexp_replace({s.squeeze('line')}, '^[^a-zA-Zༀ-࿿]+|[^a-zA-Zༀ-࿿\s''-]+$', '', 'g'))"
    other = s.squeeze(r"regexp_replace(line, '\b[a-zA-Z]+\b', '', 'g')")
    column = s.squeeze(r"regexp_replace(line, '\s+x\s*$', '')")
    return f"WITH {_SQL_LINES} SELECT p_partkey, {page} AS page, {s.english('line')} AS english, {s.english_column('line')} AS english_column, {s.tibetan('line')} AS tibetan, {column} AS tibetan_column, {entry} AS entry, {other} AS without_english FROM lines"


@query(_cleaners())
def q_line_cleaners(t):
    c = _c("line")
    return _lines(t).select("p_partkey", P.clean_page(c).alias("page"), P.clean_english(c).alias("english"), P.clean_english_column(c).alias("english_column"), P.clean_tibetan(c).alias("tibetan"), P.clean_tibetan_column(c).alias("tibetan_column"), P.clean_entry(c).alias("entry"), P.without_english(c).alias("without_english"))


def _predicates():
    s, e, b = Sql, "split_part(line, ' ', 1)", "substr(line, strpos(line, ' ') + 1)"
    low = f"lower({s.strip(e)})"
    rules = {
        "english": s.full(e, P.ENGLISH), "subject": s.full(e, P.SUBJECT), "word": s.english_word(e), "term": f"length({e}) >= 3 AND {s.has(e, '[a-zA-Z]')}",
        "column_english": f"{s.full(s.strip(e), P.ENGLISH)} AND length({s.strip(e)}) >= 3", "other_script": s.has("line", P.OTHER_SCRIPTS), "content": f"length({s.strip('line')}) > 3 AND {s.has('line', '[a-zA-Zༀ-࿿]')}",
        "starts": s.has("line", "^[a-zA-Z]"), "lower_case": s.has("line", "^[a-z]"), "completes": s.has("line", "[ༀ-࿿]།"),
        "valid_english": f"length({low}) BETWEEN 2 AND 50 AND {s.full(low, P.ENGLISH)} AND {low} NOT IN ('abbreviations', 'glossary', 'terms', 'page', 'tibetan')",
        "valid_pair": f"length({e}) BETWEEN 2 AND 100 AND length({b}) >= 2 AND ({s.has(b, '[ༀ-࿿]')} OR starts_with({b}, '[Tibetan OCR failed')) AND {s.full(e, P.ENGLISH)}",
        "valid_entry": f"length({e}) BETWEEN 3 AND 50 AND length({b}) >= 2 AND {s.has(b, '[ༀ-࿿]')} AND {s.full(e, P.ENGLISH)} AND {e} NOT IN ('abbreviations', 'glossary', 'terms', 'page', 'tibetan', 'serial')",
    }
    return f"WITH {_SQL_LINES} SELECT p_partkey, {', '.join(f'({v}) AS {k}' for k, v in rules.items())} FROM lines"


@query(_predicates())
def q_line_predicates(t):
    c, e = _c("line"), F.substring_index("line", " ", 1)
    b = F.substr(c, F.instr(c, " ") + 1, F.length(c))
    rules = {
        "english": P.is_english(e), "subject": P.is_subject(e), "word": P.is_english_word(e), "term": P.is_term(e), "column_english": P.is_column_english(e), "other_script": P.has_other_script(c), "content": P.has_content(c),
        "starts": P.starts_with_english(c), "lower_case": P.starts_with_lower_case(c), "completes": P.completes(c), "valid_english": P.valid_english(e), "valid_pair": P.valid_pair(e, b), "valid_entry": P.valid_entry(e, b),
    }
    return _lines(t).select("p_partkey", *[v.alias(k) for k, v in rules.items()])


_SETS = {"four": P.FOUR_COLUMN_RULES, "line": P.LINE_RULES, "coordinate": P.COORDINATE_RULES, "chain": P.CHAIN_RULES, "smart": P.SMART_RULES, "content": P.CONTENT_RULES, "rebuilt": P.REBUILT_RULES}
_TIBETAN_SQL = "substr(line, greatest(strpos(line, regexp_extract(line, '[ༀ-࿿]')), 1))"


def _split_sql(name: str) -> str:
    return f"WITH {_SQL_LINES}, b AS (SELECT p_partkey, {_TIBETAN_SQL} AS body FROM lines), s AS (SELECT p_partkey, {Sql.split('body', _SETS[name])} AS p FROM b) SELECT p_partkey, p.term AS term, p.definition AS definition FROM s"


def _bodies(t):
    first = F.regexp_extract("line", "(?s)^[^ༀ-࿿]*[ༀ-࿿]", 0)
    return _lines(t).select("p_partkey", F.substr("line", F.greatest(F.length(first), F.lit(1)), F.length("line")).alias("body"))


def _split_query(name: str):
    def run(t):
        return _bodies(t).withColumn("p", P.split_term(_c("body"), _SETS[name])).select("p_partkey", "p.term", "p.definition")

    run.__name__ = f"q_split_{name}"
    return run


for _name in _SETS:
    query(_split_sql(_name))(_split_query(_name))


def _tsv_split():
    rest, after = Sql.strip("substr(t, shad + 2)"), "length(regexp_extract(substr(t, 26, 15), '^[^།་]*[།་]'))"
    return f"""WITH {_SQL_LINES}, b AS (SELECT p_partkey, {_TIBETAN_SQL} AS t FROM lines), s AS (SELECT *, strpos(t, '།') - 1 AS shad, strpos(t, '་་') - 1 AS two, {after} AS n FROM b)
SELECT p_partkey, CASE WHEN shad > 0 AND shad < 50 AND length({rest}) > 10 THEN left(t, shad + 1) WHEN two > 10 AND two < 50 THEN left(t, two) WHEN length(t) > 60 AND n > 0 THEN left(t, n + 25) WHEN length(t) > 60 THEN left(t, 30) || '།' ELSE t END AS term,
  CASE WHEN shad > 0 AND shad < 50 AND length({rest}) > 10 THEN {rest} WHEN two > 10 AND two < 50 THEN substr(t, two + 3) WHEN length(t) > 60 AND n > 0 THEN substr(t, n + 26) WHEN length(t) > 60 THEN substr(t, 31) ELSE '' END AS definition FROM s"""


@query(_tsv_split())
def q_split_tsv(t):
    return _bodies(t).withColumn("p", P.split_tsv_term(_c("body"))).select("p_partkey", "p.term", "p.definition")


_ways = {"main": (3, "page7", Sql.english("g1"), Sql.tibetan("g3"), "g2"), "abbreviation": (3, "page7", Sql.english("g2"), Sql.tibetan("g3"), "'abbrev'"), "failed": (3, "page7", Sql.english("g1"), f"'[Tibetan OCR failed: ' || left({Sql.strip('g3')}, 20) || '...]'", "g2"),
         "two_lines": (4, "page7", Sql.strip(f"{Sql.english('g1')} || ' ' || {Sql.english('g2')}"), Sql.tibetan("g4"), "g3"), "free": (3, "text", Sql.english("g1"), Sql.tibetan("g3"), "g2")}


def _extractors():
    page = Sql.strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\d+\s*$', '', 'g'), '[─━═-]{{3,}}', '', 'g'), '\s{{3,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
    parts = []
    for way, (n, source, english, tibetan, subject) in _ways.items():
        groups = ", ".join(f"unnest(regexp_extract_all({source}, {_q(P.EXTRACTORS[way])}, {i})) AS g{i}" for i in range(1, n + 1))
        valid = f"length(english) BETWEEN 2 AND 50 AND regexp_full_match(english, {_q(P.ENGLISH)}) AND english NOT IN ('abbreviations', 'glossary', 'terms', 'page', 'tibetan')" if way == "failed" else f"length(english) BETWEEN 2 AND 100 AND length(tibetan) >= 2 AND regexp_matches(tibetan, '[ༀ-࿿]') AND regexp_full_match(english, {_q(P.ENGLISH)})"
        parts.append(f"SELECT * FROM (SELECT page, '{way}' AS way, {english} AS english, {tibetan} AS tibetan, {subject} AS subject FROM (SELECT page, {groups} FROM c)) WHERE {valid}")
    return f"WITH {_SQL_PAGES}, c AS (SELECT page, text, {page} AS page7 FROM pages7) " + " UNION ALL ".join(parts)


@query(_extractors())
def q_extract_terms(t):
    return P.extracted_terms(_pages(t), "text", ["page"])


def _four_columns():
    entry = lambda c: rf"lower(regexp_replace({Sql.squeeze(c)}, '^[^a-zA-Zༀ-࿿]+|[^a-zA-Zༀ-࿿\s''-]+$', '', 'g'))"
    second, parts = "coalesce(g2, '')", []
    for way, n, english, subject, body in (("abbreviation", 3, entry("g2"), "'abbrev'", "g3"), ("main", 4, Sql.strip(f"{entry('g1')} || ' ' || {entry(second)}"), "g3", "g4")):
        groups = ", ".join(f"unnest(regexp_extract_all(text, {_q(P.FOUR_COLUMNS[way])}, {i})) AS g{i}" for i in range(1, n + 1))
        parts.append(f"SELECT page, way, english, subject, p.term AS term, p.definition AS definition FROM (SELECT page, '{way}' AS way, {english} AS english, {subject} AS subject, {Sql.split(body, P.FOUR_COLUMN_RULES)} AS p FROM (SELECT page, {groups} FROM pages7)) WHERE length(english) BETWEEN 3 AND 50 AND length(p.term) >= 2 AND regexp_matches(p.term, '[ༀ-࿿]') AND regexp_full_match(english, {_q(P.ENGLISH)}) AND english NOT IN ('abbreviations', 'glossary', 'terms', 'page', 'tibetan', 'serial')")
    return f"WITH {_SQL_PAGES} " + " UNION ALL ".join(parts)


@query(_four_columns())
def q_four_columns(t):
    return P.four_column_terms(_pages(t), "text", ["page"])


@query(f"WITH {_SQL_LINES}, s AS (SELECT p_partkey, {Sql.parsed('line')} AS p FROM lines) SELECT p_partkey, {_STRUCT} FROM s")
def q_parse_line(t):
    return _lines(t).withColumn("p", P.parse_line(_c("line"))).select("p_partkey", "p.*")


_TEXT_LINES = rf'''tl AS (SELECT page, CAST(i - 1 AS INTEGER) AS "at", {Sql.strip('x[i]')} AS line FROM (SELECT page, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pages7) WHERE {Sql.strip('x[i]')} <> '')'''


@query(f"""WITH {_SQL_PAGES}, {_TEXT_LINES}, o AS (SELECT *, {Sql.parsed('line')} AS p FROM tl), n AS (SELECT *, p.english <> '' AS head, sum(CASE WHEN p.english <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY "at") AS entry FROM o),
k AS (SELECT *, NOT head AND NOT regexp_matches(line, '[ༀ-࿿]') AND regexp_matches(line, '^[a-z]') AS e FROM n WHERE entry > 0)
SELECT page, CAST(entry AS BIGINT) AS entry, max(p.english) FILTER (head) || coalesce(string_agg(' ' || line, '' ORDER BY "at") FILTER (e), '') AS english, max(p.subject) FILTER (head) AS subject, max(p.term) FILTER (head) AS term,
  max(p.definition) FILTER (head) || coalesce(string_agg(' ' || line, '' ORDER BY "at") FILTER (NOT head AND NOT e), '') AS definition FROM k GROUP BY 1, 2""")
def q_parse_entries(t):
    return L.parsed_entries(L.text_lines(_pages(t), "text", ["page"]), ["page"])


@query(f"WITH {_SQL_LINES}, s AS (SELECT p_partkey, {Sql.detected('line')} AS p FROM lines) SELECT p_partkey, {_STRUCT} FROM s WHERE p IS NOT NULL")
def q_detect_columns(t):
    return _lines(t).withColumn("p", P.detect_columns(_c("line"))).where("p is not null").select("p_partkey", "p.*")


def _fixed():
    english, body = Sql.english_column(Sql.strip("left(line, 25)")), Sql.strip("substr(line, 36)")
    return f"""WITH {_SQL_LINES}, c AS (SELECT p_partkey, line, {english} AS e, {body} AS b FROM lines), s AS (SELECT p_partkey, e, {Sql.strip('substr(line, 26, 10)')} AS s, {Sql.let('b', Sql.by_position)} AS p FROM c
  WHERE length(line) >= 25 AND regexp_full_match(e, {_q(P.ENGLISH)}) AND length(e) >= 3 AND regexp_matches(b, {_q(P.OTHER_SCRIPTS)})) SELECT p_partkey, e AS english, s AS subject, p.term AS term, p.definition AS definition FROM s"""


@query(_fixed())
def q_fixed_positions(t):
    return _lines(t).withColumn("p", P.by_position(_c("line"))).where("p is not null").select("p_partkey", "p.*")


@query(f"""WITH {_SQL_LINES}, g AS (SELECT p_partkey, line, regexp_extract_all(line, '\\S+|\\s+') AS r FROM lines), e AS (SELECT *, list_transform(range(1, len(r) + 1), lambda i: {{'n': length(r[i]), 'e': list_sum(list_transform(r[1:i], lambda x: length(x))), 'gap': regexp_matches(r[i], '^\\s')}}) AS q FROM g),
s AS (SELECT *, list_sort(list_transform(list_sort(list_transform(list_filter(q, lambda x: x.gap), lambda x: {{'k': -x.n, 's': x.e - x.n, 'e': x.e}}))[1:3], lambda x: {{'s': x.s, 'e': x.e}})) AS cuts, len(list_filter(q, lambda x: x.gap)) AS gaps FROM e)
SELECT p_partkey, array_to_string(CASE WHEN gaps < 2 THEN [line] ELSE list_filter(list_transform(range(1, len(cuts) + 2), lambda i: {Sql.strip("substr(line, CAST(CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1].e END + 1 AS BIGINT), CAST(CASE WHEN i > len(cuts) THEN length(line) ELSE cuts[i].s END - CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1].e END AS BIGINT))")}), lambda x: x <> '') END, '|') AS parts FROM s""")
def q_widest_gaps(t):
    return _lines(t).select("p_partkey", F.array_join(P.widest_gaps(_c("line")), "|").alias("parts"))


def _simple():
    pattern = r"^([a-zA-Z][a-zA-Z\s'-]+?)\s+([a-z]{2,6})\s+(.+)$"
    g = lambda i: Sql.group("t", pattern, i)
    return f"WITH {_SQL_LINES}, s AS (SELECT p_partkey, {Sql.strip('line')} AS t FROM lines), p AS (SELECT p_partkey, {Sql.entry(Sql.strip(g(1)), g(2), Sql.split(g(3), P.CONTENT_RULES))} AS p FROM s WHERE regexp_matches(t, {_q(pattern)})) SELECT p_partkey, {_STRUCT} FROM p"


@query(_simple())
def q_simple_pattern(t):
    return _lines(t).withColumn("p", P.by_simple_pattern(_c("line"))).where("p is not null").select("p_partkey", "p.*")


_BLOCKS = f"""{_SQL_LINES}, w AS (SELECT p_partkey, line, unnest(range(1, len(regexp_split_to_array({Sql.strip('line')}, '\\s+')) + 1)) AS i, regexp_split_to_array({Sql.strip('line')}, '\\s+') AS x FROM lines),
b AS (SELECT CAST(p_partkey // 12 AS BIGINT) AS page, x[i] AS text, CAST(least(i - 1, 3) * 45 + p_partkey % 3 AS DOUBLE) AS x, CAST((p_partkey % 12) * 5 + i % 3 AS DOUBLE) AS y FROM w)"""


def _blocks(t):
    words = _lines(t).select("p_partkey", F.posexplode(F.split(P.strip(_c("line")), r"\s+")).alias("i", "text"))
    return words.select(F.floor(_c("p_partkey") / 12).cast("long").alias("page"), "text", (F.least(_c("i"), F.lit(3)) * 45 + _c("p_partkey") % 3).cast("double").alias("x"), ((_c("p_partkey") % 12) * 5 + (_c("i") + 1) % 3).cast("double").alias("y"))


_LEADERS = """{name} AS (SELECT page, list({c} ORDER BY {c}) AS v FROM (SELECT DISTINCT page, {c} FROM b) GROUP BY 1), {name}l AS (SELECT page, list_reduce(list_transform(v, lambda z: [z]), lambda acc, z: CASE WHEN z[1] - acc[-1] > {gap} THEN list_concat(acc, z) ELSE acc END) AS l FROM {name})"""


@query(f"""WITH {_BLOCKS}, {_LEADERS.format(name='cx', c='x', gap=30)}, {_LEADERS.format(name='cy', c='y', gap=3)},
o AS (SELECT b.*, len(list_filter(cyl.l, lambda z: z <= b.y)) - 1 AS row, coalesce(list_min(list_transform(range(1, len(cxl.l) + 1), lambda i: CASE WHEN b.x < cxl.l[i] + 20 THEN i END)) - 1, len(cxl.l)) AS col FROM b JOIN cxl USING (page) JOIN cyl USING (page))
SELECT page, text, x, y, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS "column" FROM o""")
def q_placed_rows(t):
    return L.placed_rows(_blocks(t), ["page"]).select("page", "text", "x", "y", "row", "column")


@query(f"""WITH {_BLOCKS}, {_LEADERS.format(name='cx', c='x', gap=30)}, {_LEADERS.format(name='cy', c='y', gap=3)},
o AS (SELECT b.*, len(list_filter(cyl.l, lambda z: z <= b.y)) - 1 AS row, coalesce(list_min(list_transform(range(1, len(cxl.l) + 1), lambda i: CASE WHEN b.x < cxl.l[i] + 20 THEN i END)) - 1, len(cxl.l)) AS col FROM b JOIN cxl USING (page) JOIN cyl USING (page)),
g AS (SELECT page, CAST(row AS INTEGER) AS row, coalesce(string_agg(text, ' ' ORDER BY x, y, text) FILTER (col = 0 AND {Sql.full('text', P.ENGLISH)}), '') AS english, coalesce(string_agg(text, ' ' ORDER BY x, y, text) FILTER (col = 1 AND {Sql.full('text', P.SUBJECT)}), '') AS subject,
  coalesce(string_agg(text, ' ' ORDER BY x, y, text) FILTER (col = 2 AND {Sql.has('text', '[ༀ-࿿]')}), '') AS term, coalesce(string_agg(text, ' ' ORDER BY x, y, text) FILTER (col >= 3), '') AS definition FROM (SELECT * FROM o WHERE text <> '') GROUP BY 1, 2),
p AS (SELECT page, row, english, subject, CASE WHEN term <> '' AND definition = '' THEN {Sql.split('term', P.COORDINATE_RULES)} ELSE {{'term': term, 'definition': definition}} END AS p FROM g),
c AS (SELECT page, row, english, subject, {Sql.squeeze("regexp_replace(p.term, '" + chr(92) + "b[a-zA-Z]+" + chr(92) + "b', '', 'g')")} AS term, {Sql.squeeze("regexp_replace(p.definition, '" + chr(92) + "b[a-zA-Z]+" + chr(92) + "b', '', 'g')")} AS definition FROM p)
SELECT * FROM c WHERE english <> '' AND term <> '' AND length(english) >= 3""")
def q_coordinate_entries(t):
    return L.coordinate_entries(_blocks(t), ["page"])


def _legal(s: str, e: str) -> str:
    starts, ends = ", ".join(map(_q, S.STARTS)), ", ".join(map(_q, S.ENDS))
    wazur = f"(starts_with({e}, 'ྭ') AND {s} <> '')"
    s2, e2 = f"CASE WHEN {wazur} THEN {s} || 'ྭ' ELSE {s} END", f"CASE WHEN {wazur} THEN ltrim({e}, 'ྭ') ELSE {e} END"
    return f"(({s2}) IN ('', {starts}) AND NOT regexp_matches({e2}, '^[ིེོུ]{{2}}') AND ltrim({e2}, 'ིེོུ') IN ('', {ends}))"


def _spelling():
    t, v = S.TELLING, "ch IN ('ི', 'ེ', 'ོ', 'ུ')"
    sub = ", ".join(map(_q, S.SUBJOINED))
    hung = f"({v} AND CASE WHEN i > 0 THEN substr(w, i, 1) ELSE right(w, 1) END = 'འ' AND i <> 1)"
    alphabet, suffixes = ", ".join(map(_q, S.ALPHABET)), ", ".join(map(_q, S.SUFFIXES))
    double = ", ".join(map(_q, S.DOUBLE_SUFFIXES))
    return f"""WITH {_SQL_LINES}, w AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[{S.WORD}]+')) AS w FROM lines), a AS (SELECT w, length(regexp_extract(w, '^[^{t}]*')) AS i FROM w),
b AS (SELECT *, substr(w, i + 1, 1) AS ch, substr(w, i + 2, 1) AS nx FROM a),
c AS (SELECT *, CASE WHEN ch IN ({sub}) THEN i + 1 WHEN {hung} THEN CASE WHEN i > 0 THEN i - 1 ELSE length(w) - 1 END WHEN {v} THEN i WHEN nx IN ({sub}) THEN i + 2 ELSE i + 1 END AS k, CASE WHEN {hung} THEN 0 WHEN ch IN ({sub}) OR {v} THEN i - 1 ELSE i END AS place FROM b),
r AS (SELECT w, CASE WHEN regexp_matches(w, '[{S.RETROFLEX}]') THEN NULL
  WHEN regexp_matches(w, '[{t}]') THEN CASE WHEN length(w) = 1 AND w IN ({alphabet}) THEN 0 WHEN {_legal('left(w, k)', 'substr(w, k + 1)')} AND place BETWEEN 0 AND 2 THEN place END
  WHEN length(w) = 1 THEN CASE WHEN w IN ({alphabet}) THEN 0 END
  WHEN length(w) = 2 THEN CASE WHEN w[1] <> w[2] AND w[2] <> 'འ' AND w[2] IN ({suffixes}) THEN 0 END
  WHEN length(w) = 3 THEN CASE WHEN w[3] IN ({suffixes}) THEN CASE WHEN substr(w, 2, 2) IN ({double}) THEN CASE WHEN w IN ('དགས', 'འགས', 'དབས', 'དམས') THEN 1 ELSE 0 END WHEN w[2] = 'འ' THEN CASE WHEN {_legal('w[1]', 'substr(w, 2, 2)')} THEN 0 END WHEN {_legal('left(w, 2)', 'w[3]')} THEN 1 END END
  WHEN length(w) = 4 THEN CASE WHEN {_legal('left(w, 2)', 'substr(w, 3, 2)')} THEN 1 END END AS place FROM c)
SELECT w AS syllable, CAST(place AS INTEGER) AS place, place IS NULL AS broken, substr(w, coalesce(place, 0) + 1, 1) AS root FROM r"""


@query(_spelling())
def q_spelling(t):
    w = _lines(t).select(F.explode(S.syllables(_c("line"))).alias("syllable")).distinct()
    c = _c("syllable")
    return w.select("syllable", S.root_place(c).cast("int").alias("place"), S.breaks_rules(c).alias("broken"), S.root(c).alias("root"))


_LETTERS = list("ཀཁགངཅཇཉཏདནཔབམཙཞཟའཡརལཤསཧཨ") + list("ྐྒྟྡྤྦྱྲླྭ") + list("ིེོུ") + ["ཊ"]


def _made(i: str) -> str:
    return f"[{', '.join(map(_q, _LETTERS))}][CAST({i} AS INTEGER) + 1]"


@query(_spelling().replace("w AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[" + S.WORD + "]+')) AS w FROM lines)", f"w AS (SELECT DISTINCT {_made(f'o_orderkey % {len(_LETTERS)}')} || {_made(f'(o_orderkey // 7) % {len(_LETTERS)}')} || CASE WHEN o_orderkey % 3 > 0 THEN {_made(f'(o_orderkey // 5) % {len(_LETTERS)}')} ELSE '' END || CASE WHEN o_orderkey % 3 > 1 THEN {_made(f'(o_orderkey // 11) % {len(_LETTERS)}')} ELSE '' END AS w FROM orders)").replace(_SQL_LINES + ", ", ""))
def q_spelling_made_up(t):
    letter = lambda i: F.element_at(F.array(*[F.lit(x) for x in _LETTERS]), (i % len(_LETTERS)).cast("int") + 1)
    k = _c("o_orderkey")
    word = F.concat(letter(k), letter(F.floor(k / 7)), F.when(k % 3 > 0, letter(F.floor(k / 5))).otherwise(""), F.when(k % 3 > 1, letter(F.floor(k / 11))).otherwise(""))
    c = _c("syllable")
    return t("orders").select(word.alias("syllable")).distinct().select("syllable", S.root_place(c).cast("int").alias("place"), S.breaks_rules(c).alias("broken"), S.root(c).alias("root"))


@query(f"WITH {_SQL_LINES}, l AS (SELECT p_partkey, line, translate(line, '{''.join(chr(0x0F90 + i) for i in range(45))}', '{''.join(chr(0x0F40 + i) for i in range(45))}') AS base, array_to_string(list_filter(regexp_extract_all(line, '[{S.WORD}]+|[^{S.WORD}]'), lambda x: x <> '་'), '|') AS parts FROM lines) SELECT p_partkey, base, parts FROM l")
def q_syllable_parts(t):
    return _lines(t).select("p_partkey", S.base_letters(_c("line")).alias("base"), F.array_join(S.syllable_parts(_c("line")), "|").alias("parts"))


@query(_spelling().replace(f"WITH {_SQL_LINES}", f"WITH {_SQL_PAGES}, {_TEXT_LINES}").replace(" AS root FROM r", " AS root FROM r").split("SELECT w AS syllable, CAST(place")[0] + f""", x AS (SELECT page, "at", unnest(CASE WHEN len(y) > 0 THEN y ELSE [NULL] END) AS w FROM (SELECT page, "at", regexp_extract_all(line, '[{S.WORD}]+') AS y FROM tl)),
j AS (SELECT page, "at", x.w, r.place IS NULL AS broken, x.w IN ('ནུས', 'པ', 'སེམས') AS known FROM x LEFT JOIN r ON x.w = r.w)
SELECT page, "at", count(w) AS n, count(*) FILTER (w IS NOT NULL AND broken AND NOT known) AS bad, count(*) FILTER (known) AS found, count(*) FILTER (w IS NOT NULL AND NOT broken) AS standard FROM j GROUP BY GROUPING SETS ((page, "at"), (page))""")
def q_spelling_scores(t):
    pages = L.text_lines(_pages(t), "text", ["page"])
    lexicon = t("region").limit(1).select(F.explode(F.array(F.lit("ནུས"), F.lit("པ"), F.lit("སེམས"))).alias("syllable"))
    s = L.spelling_scores(pages, lexicon, ["page"])
    whole = lambda c: F.coalesce(F.round(_c(c) * _c("n")), F.lit(0)).cast("long")
    return s.select("page", "at", "n", "bad", whole("dict_score").alias("found"), whole("standard_score").alias("standard"))


def _places(t: str, body) -> str:
    """``body`` of where the English part and the subject end and the Tibetan text begins."""
    s = Sql
    ahead = f"length({s.group(t, r'(?s)^(.{6,}?)(?:\s*[a-z]{2,6}\s+\S|[ༀ-࿿])', 1)})"
    blank = f"strpos(substr({t}, 11), ' ')"
    english = f"CASE WHEN {ahead} > 0 THEN {ahead} WHEN {blank} > 0 THEN {blank} + 9 ELSE length({t}) // 3 END"
    code = lambda e: s.group(f"substr({t}, {e} + 1)", "^ *([a-z,]*)", 1)
    subject = lambda e: f"{e} + length({s.group(f'substr({t}, {e} + 1)', '^( *)', 1)}) + CASE WHEN {s.full(code(e), P.SUBJECTS)} THEN length({code(e)}) ELSE 0 END"
    before = lambda u: s.group(f"substr({t}, {u} + 1)", "(?s)^([^ༀ-࿿]*)[ༀ-࿿]", 1)
    tibetan = lambda u: f"{u} + CASE WHEN {s.has(f'substr({t}, {u} + 1)', '[ༀ-࿿]')} THEN length({before(u)}) - length({s.group(before(u), '([^ ]*)$', 1)}) ELSE 0 END"
    return s.let(english, lambda e: s.let(subject(e), lambda u: s.let(tibetan(u), lambda b: body(e, u, b))))


def _content_cells(t: str) -> str:
    s = Sql
    return _places(t, lambda e, u, b: f"{{'ends': {e}, 'starts': {b}, 'english': {s.strip(f'left({t}, {e})')}, 'subject': CASE WHEN {u} > {e} THEN {s.strip(f'substr({t}, {e} + 1, {u} - {e})')} ELSE '' END, 'tibetan': CASE WHEN {b} > 0 AND {b} < length({t}) THEN {s.strip(f'substr({t}, {b} + 1)')} ELSE '' END}}")


@query(f"""WITH {_SQL_LINES}, c AS (SELECT p_partkey, {_content_cells('line')} AS c FROM lines), s AS (SELECT p_partkey, c, {Sql.split('c.tibetan', P.REBUILT_RULES)} AS p FROM c WHERE c.ends > 0 AND c.starts > 0)
SELECT p_partkey, c.english AS english, c.subject AS subject, p.term AS term, p.definition AS definition FROM s""")
def q_content_boundaries(t):
    return _lines(t).withColumn("p", P.by_content(_c("line"))).where("p is not null").select("p_partkey", "p.*")


_BEFORE = f"(?s)^([^{P.OTHER_SCRIPTS[1:-1]}]+)[{P.OTHER_SCRIPTS[1:-1]}]"
_CODE = r"(?s)^(.+?)\s+([a-z]{2,6})$"


@query(f"""WITH {_SQL_LINES}, t AS (SELECT p_partkey, {Sql.strip('line')} AS t FROM lines), h AS (SELECT *, {Sql.group('t', _BEFORE, 1)} AS h FROM t), e AS (SELECT *, {Sql.strip('h')} AS x FROM h WHERE h <> ''),
s AS (SELECT *, {Sql.group('x', _CODE, 2)} AS subject, CASE WHEN {Sql.group('x', _CODE, 2)} <> '' THEN {Sql.strip(Sql.group('x', _CODE, 1))} ELSE x END AS english FROM e),
p AS (SELECT *, {Sql.split('substr(t, length(h) + 1)', P.CONTENT_RULES)} AS p FROM s WHERE length(english) >= 3 AND regexp_matches(english, '[a-zA-Z]'))
SELECT p_partkey, english, subject, p.term AS term, p.definition AS definition FROM p""")
def q_character_transition(t):
    return _lines(t).withColumn("p", P.by_transition(_c("line"))).where("p is not null").select("p_partkey", "p.*")


def _fixed_width():
    s, word, code = Sql, "[a-zA-Z][a-zA-Z'-]*", P.SUBJECT
    rest = lambda c, n: f"ltrim(substr({c}, {n + 1}), ' ')"
    l2, l3 = rest("line", 25), rest("l2", 10)
    body = lambda w: f"({s.has(w, '[ༀ-࿿]')} OR NOT {s.has(w, '[a-zA-Z]')})"
    listed = lambda w: f"({s.full(w, code)} OR {s.full(w, '[a-z]+,[a-z]+')})"
    keep = lambda x, cond: f"list_filter({x}, lambda w: {cond('w')})"
    is_word = lambda w: s.full(w, word)
    taken = "CASE WHEN len(late) > 0 THEN list_position(spare, late[1]) ELSE 0 END"
    return f"""WITH {_SQL_LINES}, a AS (SELECT p_partkey, {s.strip('left(line, 25)')} AS c1, {l2} AS l2 FROM lines), b AS (SELECT *, {s.strip('left(l2, 10)')} AS c2, {l3} AS l3 FROM a),
c AS (SELECT *, {s.strip(f"{s.strip('left(l3, 25)')} || ' ' || {s.strip(rest('l3', 25))}")} AS body FROM b),
d AS (SELECT p_partkey, {s.words('c1')} AS e, {s.words('c2')} AS s, {s.words('body')} AS t FROM c WHERE c1 <> '' AND {s.has('body', P.OTHER_SCRIPTS)}),
f AS (SELECT *, {keep('t', lambda w: f'NOT {body(w)}')} AS spare, {keep('s', listed)} AS codes FROM d), g AS (SELECT *, CASE WHEN len(codes) = 0 THEN list_filter(spare, lambda w: {s.full('w', code)})[1:1] ELSE [] END AS late FROM f),
h AS (SELECT p_partkey, array_to_string(list_concat(list_concat({keep('e', is_word)}, {keep('s', lambda w: f'{is_word(w)} AND NOT {listed(w)}')}), list_transform(list_filter(range(1, len(spare) + 1), lambda i: {s.full('spare[i]', word)} AND i <> {taken}), lambda i: spare[i])), ' ') AS english,
  array_to_string(list_concat(codes, late), ' ') AS subject, array_to_string({keep('t', body)}, ' ') AS tibetan FROM g), p AS (SELECT *, {s.split('tibetan', P.REBUILT_RULES)} AS p FROM h)
SELECT p_partkey, english, subject, p.term AS term, p.definition AS definition FROM p"""


@query(_fixed_width())
def q_fixed_width_columns(t):
    return _lines(t).withColumn("p", P.by_fixed_width(_c("line"))).where("p is not null").select("p_partkey", "p.*")


def _two_lines():
    s = Sql
    english = lambda c: s.english_column(s.strip(f"left({c}, 25)"))
    return f"""WITH {_SQL_LINES}, n AS (SELECT p_partkey // 7 AS page, p_partkey AS k, line, lead(line) OVER (PARTITION BY p_partkey // 7 ORDER BY p_partkey) AS nxt FROM lines),
c AS (SELECT page, k, {english('line')} AS e1, {english('nxt')} AS e2, {s.strip('substr(line, 26)')} AS more, {s.strip('substr(nxt, 26, 10)')} AS subject, {s.strip('substr(nxt, 36)')} AS body FROM n WHERE nxt IS NOT NULL),
p AS (SELECT *, {s.let('body', s.by_position)} AS p FROM c WHERE NOT (length(more) > 3 AND {s.has('more', '[a-zA-Zༀ-࿿]')}) AND {s.full('e1', P.ENGLISH)} AND length(e1) >= 3 AND {s.full('e2', P.ENGLISH)} AND length(e2) >= 3 AND {s.has('body', P.OTHER_SCRIPTS)})
SELECT page, k, e1 || ' ' || e2 AS english, subject, p.term AS term, p.definition AS definition FROM p"""


@query(_two_lines())
def q_two_line_terms(t):
    return L.two_line_entries(_lines(t).select(F.floor(_c("p_partkey") / 7).cast("long").alias("page"), _c("p_partkey").alias("k"), "line"), ["page"], "k")


def _rebuilt():
    s = Sql
    latin, tib = s.has("line", "[a-zA-Z]"), s.has("line", "[ༀ-࿿]")
    script = lambda cond: f"array_to_string(list_filter(parts, lambda w: {cond}), ' ')"
    both = f"(({latin}) = ({tib}))"
    to_d = f"(NOT head AND {tib} AND NOT {latin} AND begun AND (contains(line, '།') OR length(line) > 30))"
    cell = lambda c: s.strip(f"""coalesce(string_agg({c}, ' ' ORDER BY "at") FILTER ({c} <> ''), '')""")
    return f"""h AS (SELECT *, {s.has('line', '^[a-zA-Z]')} OR row_number() OVER (PARTITION BY page ORDER BY "at") = 1 AS head, {_content_cells('line')} AS cells, regexp_split_to_array(line, '\\s{{2,}}') AS parts FROM tl),
i AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY "at") AS entry FROM h),
j AS (SELECT *, coalesce(max(CASE WHEN CASE WHEN head THEN cells.tibetan <> '' ELSE {tib} END THEN 1 ELSE 0 END) OVER (PARTITION BY page, entry ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS begun FROM i),
k AS (SELECT page, entry, "at", CASE WHEN head THEN cells.english WHEN {latin} AND NOT {tib} THEN line WHEN {both} AND len(parts) > 1 THEN {script(f"{s.has('w', '[a-zA-Z]')} AND NOT {s.has('w', '[ༀ-࿿]')}")} WHEN {both} AND NOT {tib} THEN line END AS e,
  CASE WHEN head THEN cells.subject END AS s, CASE WHEN head THEN cells.tibetan WHEN {tib} AND NOT {latin} AND NOT {to_d} THEN line WHEN {both} AND len(parts) > 1 THEN {script(s.has('w', '[ༀ-࿿]'))} WHEN {both} AND {tib} THEN line END AS t, CASE WHEN {to_d} THEN line END AS d FROM j),
rebuilt AS (SELECT page, min("at") AS "at", {cell('e')} || ' ' || {cell('s')} || ' ' || {cell('t')} || ' ' || {cell('d')} AS line FROM k GROUP BY page, entry)"""


@query(f"""WITH {_SQL_PAGES}, {_TEXT_LINES}, {_rebuilt()} SELECT page, "at", line FROM rebuilt""")
def q_rebuilt_lines(t):
    return L.rebuilt_lines(L.text_lines(_pages(t), "text", ["page"]), ["page"])


_COLUMN_1 = Sql.english_column(Sql.strip("left(line, 25)"))


@query(f"""WITH {_SQL_PAGES}, {_TEXT_LINES}, {_rebuilt()}, o AS (SELECT page, "at", {Sql.strip('line')} AS line FROM rebuilt), b AS (SELECT *, {Sql.full(_COLUMN_1, P.ENGLISH)} AND length({_COLUMN_1}) >= 3 AS begins, {Sql.detected('line')} AS p FROM o),
c AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY "at") AS part FROM b), d AS (SELECT *, string_agg(line, ' ') FILTER (line <> '') OVER (PARTITION BY page, part ORDER BY "at" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest FROM c)
SELECT page, "at", p.english AS english, p.subject AS subject, p.term AS term, {Sql.strip("concat_ws(' ', nullif(p.definition, ''), rest)")} AS definition FROM d WHERE p IS NOT NULL""")
def q_column_entries(t):
    return L.column_entries(L.rebuilt_lines(L.text_lines(_pages(t), "text", ["page"]), ["page"]), ["page"])
