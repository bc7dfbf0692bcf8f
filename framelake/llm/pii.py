"""Personal data: spans proposed by generators of high recall, chosen by boosted trees, all in SQL expressions.

What the base patterns find always stays. Besides, generators propose candidates that overlap (addresses in brackets,
spelled or spaced, numbers grouped in other ways, numbers without a plus, long addresses of hosts). Boosted trees score
each by its format and context; one stays when its calibrated probability reaches its kind's threshold, no base span
overlaps it, and no candidate that overlaps it is likelier. Trees and thresholds are those of `pii_model`; they are
compiled into CASE expressions, so everything runs inside the JVM as one projection without a shuffle.

Offsets are code points, end exclusive. Places are running sums over the matches and the gaps between them, and arrays
grow in chunks, so a text takes time in proportion to its length nearly whatever it holds. Null texts have no spans;
repeated rows give repeated results; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pii_model
from .pii_model import AFTER, BEFORE, CLASSES, DIGITS, FLAGS, GENERATORS, KINDS

# Possessive forms and look-behinds find what the plain patterns find, but never step back or start within a run, so
# long runs take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # whole runs of 16 to 19 digits: other runs are dropped by their length anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no base span of the kind, and is not walked.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Entries of an array that grows by appending.
CHUNK = 256
SPAN = "struct<start:int,end:int,found:string,before:string,after:string>"
SCORED = "struct<start:int,end:int,p:double,kind:int>"


def let(value: str, name: str, body: str) -> str:
    """The body with the value evaluated once under that name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def none(item: str) -> str:
    return f"cast(array() as array<{item}>)"


def running(values: str, first: str, step: str, item: str) -> str:
    """What a fold emits (out), and its last state: step, of the state `a.state` and the value `x`, gives a struct of the next state and an entry or null.

    Entries go into chunks, so that appending copies a chunk and not all that came before.
    """
    full = f"size(a.chunk) >= {CHUNK}"
    chunk = f"CASE WHEN r.entry IS NULL THEN a.chunk WHEN {full} THEN array(r.entry) ELSE array_append(a.chunk, r.entry) END"
    chunks = f"CASE WHEN r.entry IS NOT NULL AND {full} THEN array_append(a.chunks, a.chunk) ELSE a.chunks END"
    merged = let(step, "r", f"named_struct('state', r.state, 'chunk', {chunk}, 'chunks', {chunks})")
    start = f"named_struct('state', {first}, 'chunk', {none(item)}, 'chunks', {none(f'array<{item}>')})"
    return f"aggregate({values}, {start}, (a, x) -> {merged}, a -> named_struct('state', a.state, 'out', flatten(array_append(a.chunks, a.chunk))))"


def located(pattern: str) -> str:
    """The leftmost non-overlapping matches of a pattern in `text`: start, end, what was found, and the context up to the next matches."""
    lengths = "transform(b.found, (f, i) -> char_length(get(b.gaps, i)) + char_length(f))"
    ends = running(lengths, "0", let("a.state + x", "t", "named_struct('state', t, 'entry', t)"), "int") + ".out"
    places = f"zip_with(b.found, {ends}, (f, e) -> named_struct('start', e - char_length(f), 'end', e, 'found', f))"
    context = f"named_struct('start', m.start, 'end', m.end, 'found', m.found, 'before', right(get(b.gaps, i), {BEFORE}), 'after', left(get(b.gaps, i + 1), {AFTER}))"
    both = f"named_struct('gaps', split(text, r'{pattern}', -1), 'found', regexp_extract_all(text, r'{pattern}', 0))"
    return let(both, "b", f"CASE WHEN size(b.found) = 0 THEN {none(SPAN)} ELSE transform({places}, (m, i) -> {context}) END")


def digits_of(found: str) -> str:
    return f"regexp_replace({found}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether the digits pass: every second one from the right is doubled."""
    value = "cast(substring(d, i, 1) as int)"
    doubled = let(value, "v", "CASE WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END")
    total = f"aggregate(sequence(1, char_length(d)), 0, (t, i) -> t + CASE WHEN (char_length(d) - i) % 2 = 1 THEN {doubled} ELSE {value} END)"
    return let(digits, "d", f"CASE WHEN char_length(d) > 0 THEN {total} % 10 = 0 ELSE false END")


def at_most_255(numbers: str) -> str:
    """Whether all of an array of digits are numbers up to 255."""
    return f"forall({numbers}, n -> {let("regexp_replace(n, '^0+', '')", 'z', "char_length(z) < 3 OR char_length(z) = 3 AND z <= '255'")})"


def holds(kind: str) -> str:
    """Whether what a base pattern found is one: parts, digits and checksum."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return at_most_255(r"split(m.found, r'\.')")
    n = f"char_length({digits_of('m.found')})"
    return f"{n} BETWEEN 8 AND 15" if kind == "phone" else f"CASE WHEN {n} BETWEEN 16 AND 19 THEN {luhn(digits_of('m.found'))} ELSE false END"


def base_of(kind: str) -> str:
    """The base spans, as likelier than any candidate."""
    found = f"filter({located(BASE[kind])}, m -> {holds(kind)})"
    spans = f"transform({found}, m -> named_struct('start', m.start, 'end', m.end, 'p', 2.0D, 'kind', {KINDS.index(kind)}))"
    return f"CASE WHEN text rlike r'{NEEDS[kind]}' THEN {spans} ELSE {none(SCORED)} END"


def features() -> str:
    """The features of a candidate m as an array of doubles, in the order of pii_model.FEATURES."""
    flags = [f"m.{where} rlike r'{pattern}'" for _, where, pattern in FLAGS]
    classes = [f"char_length(regexp_replace(m.found, '[^{c}]', ''))" for c in CLASSES.values()]
    size = lambda g: f"char_length(coalesce({g}, ''))"
    measures = [
        "char_length(m.found)", "size(g.groups)", "coalesce(array_max(transform(g.groups, z -> char_length(z))), 0)", size("get(g.groups, 0)"), size("try_element_at(g.groups, -1)"),
        "CASE WHEN g.digits = '' THEN 0 ELSE size(array_distinct(split(g.digits, '(?!^)'))) END", luhn("g.digits"), at_most_255("g.groups"),
    ]
    both = f"named_struct('groups', regexp_extract_all(m.found, '[0-9]+', 0), 'digits', {digits_of('m.found')})"
    return let(both, "g", f"array({', '.join(f'cast({e} as double)' for e in (*flags, *classes, *measures))})")


def proposed(kind: str) -> str:
    """The candidates of the kind's generators with their features."""
    low, high = DIGITS.get(kind, (0, 1 << 30))
    found = ", ".join(f"CASE WHEN text rlike r'{p}' THEN {located(p)} ELSE {none(SPAN)} END" for k, p in GENERATORS if k == kind)
    fit = f"char_length({digits_of('m.found')}) BETWEEN {low} AND {high}"
    return f"transform(filter(concat({found}), m -> {fit}), m -> named_struct('start', m.start, 'end', m.end, 'x', {features()}))"


def probability(kind: str, values: str) -> str:
    """The calibrated trees as SQL of CASEs over an array of features."""
    model = pii_model.fit(kind)
    trees = model.trees

    def branch(t: int, node: int) -> str:
        if node >= len(trees.feature[t]):
            return f"{float(trees.leaf[t][node - len(trees.feature[t])])!r}D"
        if trees.cut[t][node] == float("inf"):  # not split: all go to the left
            return branch(t, 2 * node + 1)
        return f"CASE WHEN {values}[{trees.feature[t][node]}] > {float(trees.cut[t][node])!r}D THEN {branch(t, 2 * node + 2)} ELSE {branch(t, 2 * node + 1)} END"

    margin = " + ".join([f"{float(trees.bias)!r}D", *(branch(t, 0) for t in range(len(trees.feature)))])
    return f"1 / (1 + exp(-({model.slope!r}D * ({margin}) + {model.offset!r}D)))"


def scored(kind: str, candidates: str) -> str:
    """The candidates that reach their kind's threshold, with their probability."""
    entry = f"named_struct('start', m.start, 'end', m.end, 'p', {probability(kind, 'm.x')}, 'kind', {KINDS.index(kind)})"
    return f"filter(transform({candidates}, m -> {entry}), m -> m.p >= {pii_model.fit(kind).threshold!r}D)"


def chosen(spans: str) -> str:
    """Of candidates and base spans (p = 2), in the order of their starts, the candidates that stay: one that a base span overlaps goes, and of candidates that overlap the likelier stays."""
    nothing = f"cast(null as {SCORED})"
    state = lambda held, covered: f"named_struct('held', {held}, 'covered', {covered})"
    clear = "a.state.held.end <= x.start"
    out = f"CASE WHEN a.state.held IS NOT NULL AND {clear} THEN a.state.held END"
    base = f"named_struct('state', {state(nothing, 'greatest(a.state.covered, x.end)')}, 'entry', {out})"
    hidden = f"named_struct('state', a.state, 'entry', {nothing})"
    held = f"CASE WHEN a.state.held IS NULL OR {clear} OR x.p > a.state.held.p THEN x ELSE a.state.held END"
    taken = f"named_struct('state', {state(held, 'a.state.covered')}, 'entry', {out})"
    step = f"CASE WHEN x.p > 1 THEN {base} WHEN x.start < a.state.covered THEN {hidden} ELSE {taken} END"
    return let(running(spans, state(nothing, "0"), step, SCORED), "s", "CASE WHEN s.state.held IS NULL THEN s.out ELSE array_append(s.out, s.state.held) END")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, `base` and `spans`: arrays of (kind, start, end) by kind, then start; base holds the base spans alone."""
    first = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    proposals = first.selectExpr("id", f"concat({', '.join(map(base_of, KINDS))}) AS base", *(f"{proposed(k)} AS more_{k}" for k in KINDS))
    found = proposals.selectExpr("id", "base", f"concat({', '.join(scored(k, f'more_{k}') for k in KINDS)}) AS more")
    kept = found.selectExpr("id", "base", f"CASE WHEN size(more) = 0 THEN {none(SCORED)} ELSE {chosen('array_sort(concat(base, more))')} END AS extra")
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    sorted_spans = lambda spans: f"array_sort(transform({spans}, m -> named_struct('rank', m.kind, 'start', m.start, 'end', m.end)))"
    named = lambda spans: f"transform({sorted_spans(spans)}, m -> named_struct('kind', get({names}, m.rank), 'start', m.start, 'end', m.end))"
    return kept.selectExpr("id", f"{named('base')} AS base", f"{named('concat(base, extra)')} AS spans").withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counts(spans: Column) -> list[Column]:
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return [number(k) for k in KINDS]


#: Code points of the pieces that a text is cut into for redaction.
PIECE = 1024


def part(start: str, end: str) -> str:
    """The text from start to end, from the pieces `p.pieces`: only the pieces that it touches are walked."""
    at, piece = lambda place: f"cast(floor(({place}) / {PIECE}) as int)", lambda k: f"coalesce(get(p.pieces, {k}), '')"
    within = f"substring({piece(at(start))}, ({start}) % {PIECE} + 1, ({end}) - ({start}))"
    middle = f"array_join(slice(p.pieces, {at(start)} + 2, greatest(0, {at(end)} - {at(start)} - 1)), '')"
    across = f"concat(substring({piece(at(start))}, ({start}) % {PIECE} + 1, {PIECE}), {middle}, substring({piece(at(end))}, 1, ({end}) % {PIECE}))"
    return f"CASE WHEN {at(start)} = {at(end)} THEN {within} ELSE {across} END"


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with each span replaced by <kind>; spans that overlap go as one, named by the first. Other columns stay.

    Works on rows by themselves: the spans are computed beside the text, so no join is needed and repeated ids are fine.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    found = personal_data(rows, "row", "text").withColumn("text", F.col("row").getField(text_col))
    ordered = "array_sort(transform(spans, s -> named_struct('start', s.start, 'back', -s.end, 'kind', s.kind)))"
    entry = f"CASE WHEN x.start >= a.state THEN concat({part('a.state', 'x.start')}, '<', x.kind, '>') END"
    walk = running("p.spans", "0", f"named_struct('state', greatest(a.state, -x.back), 'entry', {entry})", "string")
    new = let(walk, "w", f"concat(array_join(w.out, ''), {part('w.state', 'p.length')})")
    whole = f"named_struct('pieces', regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0), 'spans', {ordered}, 'length', char_length(text))"
    fixed = F.expr(f"CASE WHEN size(spans) = 0 THEN text ELSE {let(whole, 'p', new)} END")
    return found.select(*(fixed.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
