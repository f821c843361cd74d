import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from tidemark.llm import pii_bootstrap as pii
from tidemark.llm.queries import queries

from .conftest import ODD, frame


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def noise():
    r = random.Random(4)
    bits = ["a@b.co", "x@y", "@", ".", "..", "1.2.3.4", "256.1.1.1", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "+", "12", " ", "-", "é", "𝒳", "%d@e.f-g.h", "+33.1.22.33.44.55", "\n", "w"]
    return [(1000 + i, "".join(r.choice(bits) for _ in range(r.randrange(1, 30)))) for i in range(400)]


def test_forms_equal_brute_force(spark):
    pairs = [*noise(), *[p for p in ODD if p[0] != 7], (20, "1.1.1.1." * 3000 + "a@" * 500), (21, "9" * 20_000), (22, "+1" + "(" * 20_000)]
    want = {i: brute(t or "") for i, t in pairs}
    got = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.finish}" for s in r.base) for r in pii.find(frame(spark, pairs)).collect()}
    assert got == want


def test_contexts_discover_what_no_form_finds(spark):
    seeds = [(i, f"some words then Call me:  +1 555 010 {1000 + i} and a dull 2024 year 19{i % 90 + 10}0 more") for i in range(8)]
    other = [(100 + i, f"plain words then the year 19{i}000 more {i}") for i in range(10)]
    unseen = [(200, "now call me: 555-0199-77 please"), (201, "nothing to call at 555-0199-77 here")]
    rows = {r.doc_id: r for r in pii.find(frame(spark, seeds + other + unseen)).collect()}
    (span,) = rows[200].spans
    assert (span.kind, "now call me: 555-0199-77 please"[span.start : span.finish]) == ("phone", "555-0199-77")
    assert rows[201].spans == [] and all(len(rows[i].spans) == 1 for i, _ in seeds) and all(rows[i].spans == [] for i, _ in other)
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, seeds + unseen)).collect()}
    assert clean[200] == "now call me: <PHONE> please" and clean[201] == unseen[1][1]


def test_redaction_leaves_no_seed(spark):
    pairs = [*noise()[:80], *ODD]
    docs = frame(spark, pairs)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(pairs)
    for r in out.collect():
        assert r.n_chars == len(r.text or "")
    untouched = {i: t for i, t in pairs if not brute(t or "")}
    assert all(r.text == untouched[r.doc_id] for r in out.collect() if r.doc_id in untouched)


def test_query_columns(spark, sf_small, empty):
    rows = queries()["op3_contextual_pii"](spark, sf_small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


def test_behind_a_pattern_no_digits_are_needed(spark):
    """Short, grouped and digitless identifiers behind accepted patterns are spans, wherever they begin."""
    seeds = [(i, f"some words then Call me:  +1 555 010 {1000 + i} and more") for i in range(9)]
    seeds += [(20 + i, f"you may Write to: user{i}@example.com about it") for i in range(9)]
    unseen = {
        100: ("now call me: 555 010 199 please", "now call me: <PHONE> please"),
        101: ("now call me: (555) 0199, please", "now call me: <PHONE>, please"),
        102: ("now call me: 555-01 or not", "now call me: <PHONE> or not"),
        103: ("so write to: jane.doe@intranet, soon", "so write to: <EMAIL>, soon"),
        104: ('so write to: "jane(at)example.com" soon', 'so write to: "<EMAIL>" soon'),
        105: ("nothing to call at 555 010 199 here", "nothing to call at 555 010 199 here"),
        106: ("é call  me:\n 55 (01) - 2\nwrite to: -- ok", "é call  me:\n <PHONE>\nwrite to: -- ok"),
        107: ("now call me: 12 +1 555 010 1000 end", "now call me: <PHONE> <PHONE> end"),
    }
    docs = frame(spark, seeds + [(i, t) for i, (t, _) in unseen.items()])
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert {i: clean[i] for i in unseen} == {i: t for i, (_, t) in unseen.items()}
    for r in pii.find(docs).collect():
        if r.doc_id == 103:
            ((kind, a, b),) = [(s.kind, s.start, s.finish) for s in r.spans]
            assert kind == "email" and unseen[103][0][a:b] == "jane.doe@intranet"


def patterns(left):
    words = [w.lower()[-pii.WORD :] for w in re.split(r"[ \t\n\x0b\f\r]+", left) if w]
    return ([" ".join(words[-2:])] if len(words) > 1 else []) + (words[-1:] if words and words[-1][-1] in ":=#" else [])


def graph(texts):
    """Accepted patterns by plain Python: scores of patterns and instances in turn, over all occurrences."""
    known, unknown, total = Counter(), Counter(), Counter()
    for t in texts:
        places = {m.end() for m in re.finditer(r"[ \t\n\x0b\f\r]+(?=[^ \t\n\x0b\f\r])", t)}
        places |= {m.end() for m in re.finditer(r"[^ \t\n\x0b\f\rA-Za-z0-9._@+-](?=[A-Za-z0-9._@+-])", t)}
        for at in places:
            total.update(patterns(t[:at]))
        seeds = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute(t).split(",") if x)]
        for k, a, b in seeds:
            known.update((p, f"{k}:{t[a:b].lower()}", k) for p in patterns(t[:a]) if a in places)
        for m in re.finditer(r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*[0-9])[A-Za-z0-9._@+-]+", t):
            if len(re.sub("[^0-9]", "", m[0])) >= 4 and not any(a < m.end() and m.start() < b for _, a, b in seeds):
                unknown.update((p, m[0].lower()) for p in patterns(t[: m.start()]))
    support = Counter((p, k) for p, _, k in known)
    backed = {x for x, n in support.items() if n >= pii.SUPPORT}
    own = Counter()
    for (p, *_), n in [*known.items(), *unknown.items()]:
        own[p] += n
    fixed = Counter()
    for (p, _, k), n in known.items():
        if p in {q for q, _ in backed}:
            fixed[p, k] += n
    weight = dict(fixed)
    for _ in range(pii.ROUNDS):
        score = {(p, k): min(0.99, w / (max(own[p], total[p]) + 1)) for (p, k), w in weight.items()}
        miss = defaultdict(float)
        for p, x in unknown:
            for (q, k), v in score.items():
                if p == q:
                    miss[x, k] += math.log1p(-v)
        weight = defaultdict(float, fixed)
        for (p, x), n in unknown.items():
            for (y, k), v in miss.items():
                if x == y and p in {q for q, _ in backed}:
                    weight[p, k] += n * (1 - math.exp(v))
    return {(p, k): round(v, 9) for (p, k), v in score.items() if v >= pii.ACCEPT and (p, k) in backed}


def test_graph_equals_plain_python(spark):
    r = random.Random(8)
    words = ["call", "me:", "Phone=", "mail", "id#", "the", "x" * 70 + ":", "at"]
    accepted = 0
    for corpus in range(6):
        texts = []
        for i in range(120):
            t = ""
            for _ in range(r.randrange(1, 9)):
                lead = r.choice(words[:4]) + r.choice([" ", "  \n", " " * 300]) + r.choice(words)
                value = r.choice([f"+1 555 010 {r.randrange(1000, 1040)}", f"u{r.randrange(30)}@ex.org", f"AB-{r.randrange(2000, 2012)}", "soon", f"10.0.0.{r.randrange(30)}"])
                t += lead + r.choice([" ", "\t", ""]) + value + " "
            texts.append(t)
        got = {(x.pattern, x.kind): round(x.score, 9) for x in pii.Extraction(frame(spark, list(enumerate(texts)))).accepted.collect()}
        assert got == graph(texts)
        accepted += len(got)
    assert accepted > 3


def test_patterns_that_end_inside_of_words(spark):
    """Digits behind a plus sign vouch for nothing; a label joined to its value is counted wherever it stands."""
    cards = [f"x reach: +49 30 12345{n:03d}" for n in range(40)]
    assert sum("card" in brute(t) for t in cards) == 4
    got = {(x.pattern, x.kind): x.score for x in pii.Extraction(frame(spark, list(enumerate(cards)))).accepted.collect()}
    assert got == {k: v for k, v in got.items() if k[1] == "phone"} and ("reach:", "phone") in got
    joined = [f"a note tel:+1 555 010 {1000 + n}" for n in range(9)] + [f"a note tel:none{n}" for n in range(12)]
    assert pii.Extraction(frame(spark, list(enumerate(joined)))).accepted.collect() == []
    assert {x.pattern for x in pii.Extraction(frame(spark, list(enumerate(joined[:12])))).accepted.collect()} == {"tel:", "note tel:"}


def test_words_of_many_short_tokens(spark):
    """The front of a word counts however many tokens it is made of."""
    word = "/".join("ab1"[:1] + str(i % 10) for i in range(19)) + ":"
    texts = [f"{word[:-1]}/z{i}:+1 555 010 {1000 + i}" for i in range(9)]
    got = {(x.pattern, x.kind): round(x.score, 9) for x in pii.Extraction(frame(spark, list(enumerate(texts)))).accepted.collect()}
    assert got == graph(texts)
    texts = [f"the {word}+1 555 010 {1000 + i}" for i in range(9)]
    got = {(x.pattern, x.kind): round(x.score, 9) for x in pii.Extraction(frame(spark, list(enumerate(texts)))).accepted.collect()}
    assert got == graph(texts) and len(got) == 2


def test_long_tokens_and_words_are_read_whole(spark):
    seeds = [(i, f"some words then Call me:  +1 555 010 {1000 + i} and more") for i in range(9)]
    seeds += [(20 + i, f"{'w' * 300}{i % 2} {'v' * 90}: user{i}@example.com") for i in range(9)]
    token = "b" * 60 + "-0199-77"
    unseen = [(50, f"call me: {token} x"), (51, f"{'u' * 77}{'v' * 41}: jane(at)home x")]
    rows = {x.doc_id: [(s.kind, s.start, s.finish) for s in x.spans] for x in pii.find(frame(spark, seeds + unseen)).collect()}
    assert rows[50] == [("phone", 9, 9 + len(token))]
    at = unseen[1][1].index("jane")
    assert rows[51] == [("email", at, at + len("jane(at)home"))]


def test_many_spans_in_one_text_take_no_square_of_time(spark):
    line = " ".join(f"10.{i % 250}.{i // 250 % 250}.7" for i in range(20_000))
    docs = frame(spark, [(1, "begin " + line), (2, "call 1234")])
    pii.redact(frame(spark, [(1, "warm 10.0.0.1 up")])).collect()
    began = time.perf_counter()
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean == {1: "begin " + " ".join(["<IP>"] * 20_000), 2: "call 1234"}
    assert time.perf_counter() - began < 40  # four passes over the text, two of them for spans
