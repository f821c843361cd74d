"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

1. *Seeds.* Four kinds of identifiers are found by their form: e-mail and IP addresses, card numbers
   (Luhn) and international phone numbers; leftmost and non-overlapping for each kind. Matches that
   fail a check are dropped and not tried anew.
2. *Vouching tokens* are other tokens with at least ``VOUCHING_DIGITS`` digits. Only they and seeds add to
   the scores of patterns: ordinary words would lift every pattern that they stand behind, again each
   round (one with a seed share of 0.3 to 0.64 in three rounds).
3. *Graph.* What stands left of a span is its lexical pattern: the two words before it, and the one
   word before it if that ends like a label (``:``, ``=``, ``#``). Of a word the last ``WORD`` code points
   count, everywhere alike; blanks between words may be many. Patterns and the instances (values) that
   they stand before are the two sides of a graph; its edges are counted, combined before the shuffle. Patterns end
   at *places*: where a word begins, or a token inside of a word, as behind ``tel:``. A seed that begins elsewhere, as
   digits behind a plus sign or a letter, is a span but vouches for no pattern.
4. *Scores.* Seeds have score 1. A pattern's score for a kind is the share of all places in the
   corpus that it ends at, whatever follows, that are instances of the kind, weighted by their scores; a candidate's is
   the noisy-or of its patterns' scores. The two are computed in turn, ``ROUNDS`` times.
5. Patterns with a score of at least ``ACCEPT`` and ``SUPPORT`` different seeds behind them are accepted, and
   whatever one stands before is a span of the kind that scores highest, with or without digits: the run of
   non-blank characters, begun by digits that blanks, brackets, hyphens or dots join to groups, without
   quotes and marks around it, up to the next seed. What has no letter and no digit is no span.

A pattern's occurrences are counted at all places of all documents, the same that are looked at for spans. A bitmap of the patterns' hashes,
of a fixed 128 KB, keeps words that belong to no pattern out of the shuffle.

Null texts count as empty and have no spans, as have empty ones. Repeated rows are read once each, and
each adds to the counts. Extra columns are ignored and an empty table gives an empty result. Offsets are
code points, the end exclusive. Very long texts and tokens are read whole: the patterns are possessive,
so no input makes them try again and again, and spans are placed, compared and replaced in chunks of about the
square root of their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, indexed, let, next_start, overlaps, scan
from .common import Columns, Stored, only

KINDS = ("email", "ip", "card", "phone")

# The forms of the contract. Possessive, and started only where a run starts or the last
# match ended, which changes no match but keeps long runs linear.
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to hold any seed or candidate.
ANY = "[0-9@]"
#: A token with a digit.
TOKEN = r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]++"
VOUCHING_DIGITS = 4
#: What tokens are made of; where a word begins, and where a token begins inside of one.
PART = "[A-Za-z0-9._@+-]"
WORD_BEGINS = r"(?<=\s)(?=\S)"
TOKEN_BEGINS = r"(?<=[^\sA-Za-z0-9._@+-])(?=[A-Za-z0-9._@+-])"
#: Marks before a span (brackets stay with a number), and a span with the marks after it.
LEAD = r"""^(?:["'<{\u00AB\u201C\u2018]|[(\[](?![+(\[]*[0-9]))*+"""
SPAN = r"^(?:[+(\[]*+[0-9](?:(?:\.|[\x20()\[\]-]++)?+[0-9])*+)?+\S*+"
TRAIL = r"""[.,;:!?"'()\[\]{}<>\u00BB\u201D\u2019]++$"""
BLANKS = " \t\n\x0b\f\r"
#: Code points of a word, from its end, that count in a pattern.
WORD = 40
#: Code points to the left of a span that are looked at first, and whether two whole words are among them.
NEAR, ENOUGH = 200, r"\s\S++\s++\S++\s*+$"
#: Spans before one that are read for its pattern, and read if those hold no two words: a span and the gap behind it have
#: two code points at least, so that these hold all that counts of a word.
BEFORE, FAR_BEFORE = 17, 2 * WORD
ROUNDS = 3
ACCEPT = 0.6
SUPPORT = 3
BITMAP_BITS = 1 << 20

_FOUND = "struct<start:bigint,finish:bigint,value:string>"
_SPAN = "struct<start:bigint,finish:bigint,value:string,patterns:array<string>>"
_EMPTY = f"cast(array() as array<{_SPAN}>)"
_NONE = "cast(array() as array<struct<start:long,order:int,finish:long,kind:string>>)"


def spans_of(text: Column, form: str, sound: Callable[[Column], Column]) -> Column:
    """All matches whose value is sound, with their places and patterns. Places are the lengths of matches and of
    the gaps between them, added up; patterns are read from these gaps."""

    def of(matches: Column, gaps: Column) -> Column:
        steps = F.zip_with(matches, gaps, lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("value")))

        def step(at: Column, x: Column) -> Column:
            begin = at + x["gap"]
            return F.struct((begin + x["size"]).alias("state"), F.struct(begin.alias("start"), (begin + x["size"]).alias("finish"), x["value"].alias("value")).alias("out"))

        placed = scan(steps, F.lit(0).cast("long"), step, _FOUND)
        kept = F.filter(F.transform(placed, lambda s, i: F.struct(s["start"], s["finish"], s["value"], i.alias("i"))), lambda s: sound(s["value"]))

        def named(spans: Column) -> Column:
            parts = F.flatten(F.zip_with(F.transform(gaps, _tail), matches, lambda g, m: F.array(g, m)))
            own = let(parts, lambda p: F.transform(spans, lambda s: F.struct(s["start"], s["finish"], s["value"], let(_left(p, s["i"]), lambda left: _vouched(left, s["value"])).alias("patterns"))))
            return F.when(F.size(spans) > 0, own).otherwise(F.expr(_EMPTY))

        return let(kept, named)

    found = let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda m: let(F.slice(F.split(text, form, -1), F.lit(1), F.size(m)), lambda g: of(m, g)))
    return F.when(text.rlike(form), found).otherwise(F.expr(_EMPTY))


def _short(left: Column) -> Column:
    """Blanks as one each, and more of the end of each long word than a pattern may have."""
    return F.regexp_replace(F.regexp_replace(left, r"\s+", " "), rf"(?<!\S)\S+?(?=\S{{{WORD + 20}}}(?!\S))", "")


def _tail(gap: Column) -> Column:
    """The end of a gap between matches: all that the pattern of a span behind it can hold of it."""
    return let(F.right(gap, F.lit(NEAR)), lambda r: F.when((F.length(gap) <= NEAR) | r.rlike(ENOUGH), r).otherwise(F.right(_short(gap), F.lit(NEAR))))


def _left(parts: Column, i: Column) -> Column:
    """What stands left of match ``i``: the tail before it, or that with matches and tails before where it is short."""
    own = F.get(parts, 2 * i)

    def back(n: int) -> Column:
        first = F.greatest(2 * i - 2 * n, F.lit(0))
        return _short(F.array_join(F.slice(parts, first + 1, 2 * i - first + 1), ""))

    near = let(back(BEFORE), lambda left: F.when((i <= BEFORE) | left.rlike(ENOUGH), left).otherwise(back(FAR_BEFORE)))
    return F.when((i == 0) | own.rlike(ENOUGH), own).otherwise(near)


def _vouched(left: Column, value: Column) -> Column:
    """The patterns of a span at a place; none elsewhere."""
    inside = left.rlike(r"\S$")
    place = ~inside | (~left.rlike(rf"{PART}$") & value.rlike(rf"^{PART}"))
    return F.when(place, _patterns(left)).otherwise(F.expr("cast(array() as array<string>)"))


def _word(word: Column) -> Column:
    """What counts of a word in a pattern."""
    return let(F.lower(word), lambda w: F.when(F.length(w) > WORD, F.right(w, F.lit(WORD))).otherwise(w))


def _patterns(left: Column) -> Column:
    one, two = F.regexp_extract(left, r"(?<!\S)(\S++)\s*+$", 1), F.regexp_extract(left, r"(?<!\S)(\S++)\s++\S++\s*+$", 1)
    return let(F.struct(_word(one).alias("last"), _word(two).alias("first")), lambda w: _of_words(w["first"], w["last"]))


def _of_words(first: Column, last: Column) -> Column:
    """The patterns of two words before a span (empty: none): both, a label, or both of these."""
    both = F.when((first != "") & (last != ""), F.concat(first, F.lit(" "), last))
    return F.array_compact(F.array(both, F.when(last.rlike("[:=#]$"), last)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the digits of all add up to a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _part(p: Column) -> Column:
    bare = F.ltrim(p, F.lit("0"))
    return (bare == "") | ((F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).otherwise(F.lit("0")).cast("int") <= 255))


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.when(p == "", F.lit(False)).otherwise(_part(p)))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _tagged(order: int, kind: str):
    def tag(s: Column) -> Column:
        instance = F.sha2(F.concat(F.lit(f"{kind}:"), F.lower(s["value"])), 256)
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["finish"].alias("finish"), F.lit(kind).alias("kind"), instance.alias("instance"), s["patterns"].alias("patterns"))

    return tag


def _forms(text: Column) -> dict[str, Column]:
    """The spans of each kind in ``text``."""
    may = text.rlike(ANY)
    gates = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    return {k: F.when(may & gates[k], spans_of(text, FORMS[k], lambda v, k=k: _sound(k, v))).otherwise(F.expr(_EMPTY)) for k in KINDS}


def _with_seeds(docs: DataFrame) -> DataFrame:
    """row, doc_id, text (null as empty) and its seeds: (start, order, finish, kind, instance, patterns), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = only(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    found = _forms(F.col("text"))
    return df.withColumn("seeds", F.array_sort(F.concat(*(F.transform(found[kind], _tagged(i, kind)) for i, kind in enumerate(KINDS)))))


def annotate(docs: DataFrame) -> DataFrame:
    """row, doc_id, ``seeds`` and ``candidates`` (start, finish, instance, patterns)."""
    df = _with_seeds(docs)
    may = F.col("text").rlike(ANY)
    tokens = F.when(may, spans_of(F.col("text"), TOKEN, lambda v: F.length(_digits(v)) >= VOUCHING_DIGITS)).otherwise(F.expr(_EMPTY))
    clear = let(indexed(F.col("seeds")), lambda index: F.filter(tokens, lambda s: ~overlaps(index, s["start"], s["finish"])))
    named = F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["finish"].alias("finish"), F.sha2(F.lower(s["value"]), 256).alias("instance"), s["patterns"].alias("patterns")))
    return df.select("row", "doc_id", "seeds", named.alias("candidates"))


def _pattern_hash(p: Column) -> Column:
    return F.xxhash64(p)


def _bit(h: Column) -> Column:
    return F.pmod(h, F.lit(BITMAP_BITS))


def _bitmap(hashes: DataFrame) -> Column | None:
    """A constant of fixed size with a bit for each value of the column ``h``; null without values."""
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (_bit(F.col("h")) % 64).cast("int")))
    words = hashes.groupBy(F.floor(_bit(F.col("h")) / 64).cast("int").alias("w")).agg(bits.alias("bits")).collect()
    bitmap = [0] * (BITMAP_BITS // 64)
    for w in words:
        bitmap[w["w"]] = w["bits"]
    return F.from_json(F.lit(str(bitmap)), "array<bigint>") if words else None  # folded when the query is planned


def _inside(bitmap: Column, h: Column) -> Column:
    bit = _bit(h)
    return F.call_function("shiftright", F.get(bitmap, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern ends at a place in all documents, whatever stands after it."""
    bitmap = _bitmap(patterns.select(_pattern_hash(F.col("pattern")).alias("h")))
    if bitmap is None:
        return patterns.select("pattern", F.lit(0).cast("long").alias("total"))
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = only(docs, "text").select(F.split(F.trim(text), r"\s+").alias("raw")).select("raw", F.transform("raw", _word).alias("w"))
    # Where a word begins, a pattern is the two words before it, or the last of them if that is a label.
    n = F.size("w")
    none = F.array().cast("array<long>")
    two = F.when(n > 2, F.zip_with(F.slice("w", F.lit(1), n - 2), F.slice("w", F.lit(2), n - 2), lambda a, b: _pattern_hash(F.concat(a, F.lit(" "), b)))).otherwise(none)
    label = F.transform(F.filter(F.slice("w", F.lit(1), n - 1), lambda a: a.rlike("[:=#]$")), _pattern_hash)

    # Inside of a word, what stands before the place is the last word.
    def inner(x: Column) -> Column:
        return F.flatten(F.transform(_befores(F.split(x["own"], TOKEN_BEGINS, -1)), lambda b: F.transform(_of_words(x["before"], b), _pattern_hash)))

    pairs = F.zip_with(F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), n - 1)), "raw", lambda a, b: F.struct(a.alias("before"), b.alias("own")))
    inside = F.flatten(F.transform(F.filter(pairs, lambda x: x["own"].rlike(TOKEN_BEGINS)), inner))
    h = of_words.select(F.explode(F.concat(two, label, inside)).alias("h"))
    counts = h.where(_inside(bitmap, F.col("h"))).groupBy("h").agg(F.count(F.lit(1)).alias("total"))
    return patterns.withColumn("h", _pattern_hash(F.col("pattern"))).join(counts, "h", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def _before(pieces: Column, j: Column) -> Column:
    """What counts of a word's first ``j`` pieces; each has a character at least, so that so many hold all of it."""
    return _word(F.array_join(F.slice(pieces, F.greatest(j - 2 * WORD, F.lit(0)) + 1, F.least(j, F.lit(2 * WORD))), ""))


def _befores(pieces: Column) -> Column:
    """What stands before each token inside of a word of these pieces."""
    none = F.expr("cast(array() as array<string>)")
    return let(pieces, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda j: _before(p, j))).otherwise(none))


def annotate_behind(docs: DataFrame, accepted: DataFrame) -> DataFrame:
    """As annotate(), but with candidates for all that stands behind an accepted pattern (or, by chance of
    the bitmap, another), whatever it is made of."""
    last = _bitmap(accepted.select(_pattern_hash(F.substring_index("pattern", " ", -1)).alias("h")))
    whole = _bitmap(accepted.select(_pattern_hash(F.col("pattern")).alias("h")))
    df = _with_seeds(docs)
    none = F.expr("cast(array() as array<struct<i:int,inside:int,patterns:array<string>>>)")

    def word(raw: Column, i: Column, k: int) -> Column:
        """The word ``k`` before word ``i``, as patterns have it."""
        return F.when(i >= k, _word(F.rtrim(F.get(raw, i - k), F.lit(BLANKS)))).otherwise(F.lit(""))

    def fits(w: Column) -> Column:
        return _inside(last, _pattern_hash(w))

    def begin(i: Column, inside: Column, patterns: Column) -> Column:
        found = F.filter(patterns, lambda p: _inside(whole, _pattern_hash(p)))
        return F.array(F.struct(i.alias("i"), inside.cast("int").alias("inside"), found.alias("patterns")))

    def of_word(raw: Column, x: Column, i: Column) -> Column:
        own = let(word(raw, i, 1), lambda w: F.when((i > 0) & fits(w), begin(i, F.lit(0), _of_words(word(raw, i, 2), w))).otherwise(none))

        def of_pieces(pieces: Column) -> Column:
            def of_piece(j: Column) -> Column:
                near = _before(pieces, j)
                at = F.length(F.array_join(F.slice(pieces, F.lit(1), j), ""))
                return let(near, lambda w: F.when(fits(w), begin(i, at, _of_words(word(raw, i, 1), w))).otherwise(none))

            return F.when(F.size(pieces) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), of_piece))).otherwise(none)

        inner = F.when(x.rlike(TOKEN_BEGINS), let(F.split(x, TOKEN_BEGINS, -1), of_pieces)).otherwise(none)
        return F.concat(own, inner)

    def of_text(raw: Column, index: Column) -> Column:
        begins = F.filter(F.flatten(F.transform(raw, lambda x, i: of_word(raw, x, i))), lambda b: F.size(b["patterns"]) > 0)

        def step(state: Column, b: Column) -> Column:
            """Where the word of a place begins: that of the place before, and the words between."""
            at = state["at"] + F.length(F.array_join(F.slice(raw, state["i"] + 1, b["i"] - state["i"]), ""))
            return let(at, lambda at: F.struct(F.struct(b["i"].alias("i"), at.alias("at")).alias("state"), F.struct((at + b["inside"]).alias("at"), b["i"].alias("i"), b["inside"].alias("inside"), b["patterns"].alias("patterns")).alias("out")))

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("at"))
        placed = scan(begins, zero, step, "struct<at:bigint,i:int,inside:int,patterns:array<string>>")
        free = F.filter(placed, lambda b: ~overlaps(index, b["at"], b["at"] + 1))

        def rest(b: Column) -> Column:
            """The rest of the word, and of the text where digits may go on behind it; up to the next seed."""
            more = F.coalesce(F.get(raw, b["i"] + 1), F.lit("")).rlike(r"^[()\[\]+-]*+(?:[0-9]|\s|$)")
            words = F.when(more, F.array_join(F.slice(raw, b["i"] + 1, F.size(raw)), "")).otherwise(F.get(raw, b["i"]))
            size = F.coalesce(next_start(index, b["at"]) - b["at"], F.length("text").cast("long"))
            return F.struct(b["at"].alias("at"), F.substring(words, b["inside"] + 1, size.cast("int")).alias("rest"), b["patterns"].alias("patterns"))

        def trimmed(b: Column) -> Column:
            lead = F.length(F.regexp_extract(b["rest"], LEAD, 0))
            return let(lead, lambda n: F.struct(b["at"].alias("at"), n.alias("lead"), F.regexp_replace(F.regexp_extract(F.substring(b["rest"], n + 1, F.length(b["rest"])), SPAN, 0), TRAIL, "").alias("value"), b["patterns"].alias("patterns")))

        return F.filter(F.transform(F.transform(free, rest), trimmed), lambda b: b["value"].rlike(r"[\p{L}\p{N}]"))

    def placed(b: Column) -> Column:
        start = b["at"] + b["lead"]
        return F.struct(start.alias("start"), (start + F.length(b["value"])).alias("finish"), F.sha2(F.lower(b["value"]), 256).alias("instance"), b["patterns"].alias("patterns"))

    found = let(F.split("text", WORD_BEGINS, -1), lambda raw: let(indexed(F.col("seeds")), lambda index: of_text(raw, index)))
    return df.select("row", "doc_id", "seeds", F.transform(found, placed).alias("candidates"))


class Extraction:
    """Seeds, graph and accepted patterns of a table of documents."""

    def __init__(self, docs: DataFrame):
        self.store = store = Stored(docs.sparkSession, "pii")
        self.rows = store.keep(annotate(docs), "annotated")  # stays if no pattern is accepted
        seeds = self.rows.select(F.explode("seeds").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", "s.kind")
        others = self.rows.select(F.explode("candidates").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", F.lit(None).cast("string").alias("kind"))
        edges = seeds.unionByName(others).groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n"))
        edges = store.keep(edges, "edges")
        known = edges.where("kind is not null")
        backed = known.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
        backed = store.keep(backed, "backed")
        totals = store.keep(_occurrences(docs, backed.select("pattern").distinct()), "totals")
        # Only patterns that seeds stand behind can be accepted, so only their edges are scored.
        graph = store.keep(edges.join(totals, "pattern"), "graph")
        seen = graph.groupBy("pattern").agg(F.sum("n").alias("own"))
        size = store.keep(seen.join(totals, "pattern").select("pattern", F.greatest("own", "total").alias("size")), "size")
        known, unknown = graph.where("kind is not null"), graph.where("kind is null")
        fixed = known.groupBy("pattern", "kind").agg(F.sum("n").cast("double").alias("weight"))
        weights = fixed
        for k in range(ROUNDS):
            scored = weights.groupBy("pattern", "kind").agg(F.sum("weight").alias("weight")).join(size, "pattern").select("pattern", "kind", F.least(F.lit(0.99), F.col("weight") / (F.col("size") + 1)).alias("score"))
            scored = store.keep(scored, f"patterns-{k}")
            if k + 1 < ROUNDS:
                by = unknown.join(scored, "pattern").groupBy("instance", scored["kind"]).agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
                by = store.keep(by, f"instances-{k}")
                gained = unknown.drop("kind").join(by, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("weight"))
                weights = fixed.unionByName(gained)
        self.accepted = store.keep(scored.where(F.col("score") >= ACCEPT).join(backed, ["pattern", "kind"]), "accepted")
        if self.accepted.head(1):
            # Read once more, now that it is known where spans stand.
            self.rows = store.keep(annotate_behind(docs, self.accepted), "behind")
            store.drop("annotated")

    def discovered(self) -> DataFrame:
        """row and ``more``, the spans that accepted patterns stand before, for rows that have any."""
        rank = reduce(lambda c, x: c.when(F.col("kind") == x[1], x[0]), enumerate(KINDS), F.when(F.lit(False), 0))
        places = self.rows.select("row", F.explode("candidates").alias("s")).select("row", "s.start", "s.finish", F.explode("s.patterns").alias("pattern"))
        best = places.join(self.accepted, "pattern").groupBy("row", "start", "finish").agg(F.max(F.struct("score", (-rank).alias("r"), "kind")).alias("b"))
        return best.select("row", F.struct("start", (-F.col("b.r")).alias("order"), "finish", F.col("b.kind").alias("kind")).alias("s")).groupBy("row").agg(F.collect_list("s").alias("more"))

    def spans(self) -> DataFrame:
        """row, doc_id, seeds and all spans (kind, start, finish), by start and then kind."""
        base = F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["finish"].alias("finish"), s["kind"].alias("kind")))
        both = self.rows.join(self.discovered(), "row", "left")
        return both.select("row", "doc_id", base.alias("base"), F.array_sort(F.concat(base, F.coalesce("more", F.expr(_NONE)))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["finish"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (seed spans) and spans (all spans) of each row."""
    return Extraction(docs).spans().select("doc_id", "base", "spans")


def _placed(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["finish"].alias("finish"), F.lit(kind).alias("kind"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars, if it is there,
    counts anew.

    Seeds are found again where they are replaced, so only discovered spans are joined to texts, and a
    bitmap of fixed size keeps most documents without any out of that join. Rows that repeat a text
    have the same spans, so texts are joined by their hash.
    """
    own = Columns(docs)
    text = F.coalesce(F.col(own.of("text")), F.lit(""))
    keyed = own.df.withColumn("key", F.xxhash64(text, F.sha2(text, 256)))
    work = Extraction(keyed.select(F.col("key").alias("doc_id"), F.col(own.of("text")).alias("text")))
    more = work.rows.join(work.discovered(), "row").groupBy(F.col("doc_id").alias("key")).agg(F.min(F.array_sort("more")).alias("more"))
    more = work.store.keep(more, "discovered")
    bitmap = _bitmap(more.select(F.col("key").alias("h")))
    if bitmap is None:
        both = keyed.withColumn("more", F.expr(_NONE))
    else:
        held = keyed.where(_inside(bitmap, F.col("key"))).join(more, "key", "left").select(*keyed.columns, "more")
        both = keyed.where(~_inside(bitmap, F.col("key"))).withColumn("more", F.expr(_NONE)).unionByName(held)
    found = _forms(text)
    spans = F.array_sort(F.concat(*(F.transform(found[kind], _placed(i, kind)) for i, kind in enumerate(KINDS)), F.coalesce("more", F.expr(_NONE))))
    both = both.withColumn("clean", let(spans, lambda s: F.when(F.size(s) > 0, _replaced(text, s))))
    out = both.withColumn(own.of("text"), F.coalesce("clean", own.of("text")))
    if "n_chars" in docs.columns:
        n_chars = own.of("n_chars")
        out = out.withColumn(n_chars, F.when(F.col("clean").isNotNull(), F.length("clean").cast(own.df.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return own.back(out)


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with the kind of each span (start, order, finish, kind; sorted) in its place. Gaps are cut out of
    the text of a chunk of spans, and pieces put together at the end."""

    def over_chunk(acc: Column, chunk: Column) -> Column:
        base = acc["at"]
        end = F.greatest(base, F.array_max(F.transform(chunk, lambda s: s["finish"])))

        def pieces(part: Column) -> Column:
            begin = F.struct(base.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

            def step(a: Column, s: Column) -> Column:
                gap = F.substring(part, (a["at"] - base + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
                # A span within or across the one before only moves the end.
                put = F.when(s["start"] < a["at"], F.lit("")).otherwise(F.concat(gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")))
                return F.struct(F.greatest(a["at"], s["finish"]).alias("at"), F.concat(a["out"], F.array(put)).alias("out"))

            return F.aggregate(chunk, begin, step)

        part = F.substring(text, (base + 1).cast("int"), (end - base).cast("int"))
        return let(let(part, pieces), lambda v: F.struct(v["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(v["out"], ""))).alias("out")))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(chunks(spans), begin, over_chunk, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
