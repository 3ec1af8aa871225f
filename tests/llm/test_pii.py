import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm.pii import KINDS, LEAST, SEEDS, SETTLED, SURE, TOKEN, counted, find, redacted, shown

from .helpers import clashing, docs, records, sample_rows

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def base_of(text):
    """(start, kind, stop) of the base patterns."""
    spans = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])) % 10 == 0
            if (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else 0, 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15)[kind]:
                spans.append((m.start(), kind, m.end()))
    return spans


def written_out(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def plain(text):
    return written_out(base_of(text))


def plain_discovery(texts):
    """All spans of each text, by the definition of the patterns, instances and scores."""
    totals, mentions = Counter(), []  # mentions: (text number, start, stop, kind, instance, patterns)
    seeds = []
    for t, text in enumerate(texts):
        own = base_of(text)
        for m in re.finditer(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])", text or ""):
            if re.search("[0-9]", m[0]) and re.search("[a-fA-F]", m[0]):
                own.append((m.start(), 4, m.end()))
        seeds.append(own)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for k, (_, _, w) in enumerate(words):
            totals["one", w] += 1
            if k:
                totals["two", words[k - 1][2], w] += 1

        def beside(first, last, hit):
            word = lambda k: words[k][2] if 0 <= k < len(words) else None
            l2, l1, r1, r2 = word(first - 2), word(first - 1), word(last + 1), word(last + 2)
            shape = re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", hit))
            found = [("l1", l1), ("l2", l2, l1), ("r1", r1), ("r2", r1, r2), ("ls", l1, shape), ("rs", r1, shape)]
            return [p for p in found if None not in p]

        for start, kind, stop in own:
            first = next(k for k, (a, b, _) in enumerate(words) if a <= start < b)
            last = next(k for k, (a, b, _) in enumerate(words) if a < stop <= b)
            mentions.append((t, start, stop, kind, text[start:stop].lower(), beside(first, last, text[start:stop])))
        for k, (a, b, _) in enumerate(words):
            if re.search("[0-9@]", text[a:b]) and all(stop <= a or start >= b for start, _, stop in own):
                bare = re.sub(r"^[^\w@+]+|^_+", "", text[a:b])
                core = re.sub(r"(?<=[^\W_])[\W_]+$", "", bare)
                mentions.append((t, b - len(bare), b - len(bare) + len(core), TOKEN, core.lower(), beside(k, k, core)))
    edges, held = Counter(), defaultdict(set)
    for _, _, _, kind, i, patterns in mentions:
        for p in patterns:
            edges[p, i, kind] += 1
            if kind < TOKEN:
                held[p].add(i)
    shaped = Counter()
    for (p, _, _), n in edges.items():
        shaped[p] += n
    total = {}
    for p in (p for p, found in held.items() if len(found) >= SEEDS):
        total[p] = {"l1": totals["one", p[1]], "r1": totals["one", p[1]]}.get(p[0]) or (totals["two", p[1], p[2]] if p[0] in ("l2", "r2") else shaped[p])
    total = {p: n for p, n in total.items() if shaped[p] >= LEAST * n}
    known = Counter()
    for (p, _, kind), n in edges.items():
        if p in total and kind < TOKEN:
            known[p, kind] += n
    open_edges = [(p, i, n) for (p, i, kind), n in edges.items() if p in total and kind == TOKEN]
    scores = {key: min(1.0, n / total[key[0]]) for key, n in known.items()}
    while True:
        miss = defaultdict(float)
        for p, i, _ in open_edges:
            for kind in range(TOKEN):
                if (p, kind) in scores:
                    miss[i, kind] += math.log(max(1 - scores[p, kind], 1e-9))
        gained = defaultdict(float)
        for p, i, n in open_edges:
            for kind in range(TOKEN):
                if (i, kind) in miss:
                    gained[p, kind] += n * (1 - math.exp(miss[i, kind]))
        new = {key: min(1.0, (n + gained[key]) / total[key[0]]) for key, n in known.items()}
        rise = max((new[key] - scores[key] for key in new), default=0.0)
        scores = new
        if rise <= SETTLED:
            break
    sure = {}
    for (p, kind), score in scores.items():
        if score >= SURE:
            sure[p] = min(sure.get(p, (0, 9)), (-score, kind))
    found = [list(own) for own in seeds]
    for t, start, stop, kind, i, patterns in mentions:
        best = min((sure[p] for p in patterns if p in sure), default=None)
        if kind == TOKEN and best and possible(best[1], i):
            found[t].append((start, best[1], stop))
    return [written_out(spans) for spans in found]


def possible(kind, word):
    digits = re.sub("[^0-9]", "", word)
    if kind == 1 and re.fullmatch("[0-9.]+", word):
        parts = word.split(".")
        return len(parts) == 4 and all(p and int(p) <= 255 for p in parts)
    if kind == 2:
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != 3 or 7 <= len(digits) <= 15


def test_learned_cards_pass_their_check(spark):
    rows = [(k, f"paid by card {n} yesterday", "s") for k, n in enumerate(["4111111111111111", "5500000000000004", "4012888888881881", "340000000000009"])]
    rows += [(10, "paid by card 4111.1111.1111.1111 yesterday", "s"), (11, "paid by card 4111.1111.1111.1112 yesterday", "s"), (12, "paid by card no17 yesterday", "s")]
    found = {r["doc_id"]: r for r in find(docs(spark, rows)).select("doc_id", shown(F.col("all")).alias("s"), shown(F.col("learned")).alias("l")).collect()}
    assert found[10]["s"] == found[10]["l"] == "card:13:32" and found[11]["s"] == found[12]["s"] == ""
    assert found[0]["s"] == "card:13:29" and found[0]["l"] == ""


def made_up(seed, n=250):
    """Texts of few words with identifiers behind and before some of them, seen and unseen kinds of shapes."""
    rng = random.Random(seed)
    said = [f"w{'abcdefgh'[k]}" for k in range(8)] + ["mail", "call", "from", "key", "is", "now,", "today"]
    make = [
        lambda: f"{rng.choice('xyz')}{rng.randrange(99)}@mail{rng.randrange(9)}.org", lambda: f"{rng.choice('xyz')}{rng.randrange(99)}[at]mail.org",
        lambda: f"10.{rng.randrange(255)}.0.{rng.randrange(255)}", lambda: f"+1 (402) 555-{rng.randrange(1000, 9999)}", lambda: f"402-555-{rng.randrange(1000, 9999)}",
        lambda: f'"{rng.getrandbits(160):040x}"', lambda: f"'{rng.getrandbits(60):x}'", lambda: str(rng.randrange(3000)), lambda: f"(item{rng.randrange(99)})",
    ]
    cue = {0: "mail", 1: "mail", 2: "from", 3: "call", 4: "call", 5: "key", 6: "key", 7: "now,", 8: "today"}
    rows = []
    for k in range(n):
        parts = rng.choices(said, k=rng.randint(2, 12))
        for _ in range(rng.randint(0, 3)):
            which = rng.randrange(len(make))
            at = rng.randint(0, len(parts))
            parts[at:at] = ([cue[which]] if rng.random() < 0.8 else []) + [make[which]()]
        rows.append((k, rng.choice([" ", " ", "\n"]).join(parts), "s"))
    return rows


def test_discovery_equals_brute_force(spark):
    for seed in (1, 2):
        rows = made_up(seed) + [(1000 + k, t, "s") for k, t in enumerate([None, "", " \n", "@", "7"])]
        found = {r["doc_id"]: r["s"] for r in find(clashing(docs(spark, rows))).select("doc_id", shown(F.col("all")).alias("s")).collect()}
        want = plain_discovery([t for _, t, _ in rows])
        assert [found[i] for i, _, _ in rows] == want
        assert sum(map(len, want)) > sum(len(plain(t)) for _, t, _ in rows)  # contexts do add spans


def test_contexts_are_whole_words_and_cross_hits(spark):
    long = "x" * 200
    rows = [(k, f"the {long} a{k}@b.org then", "s") for k in range(5)] + [(9, f"see c@d.org and the {long} me9[at]b then", "s")]
    found = {r["doc_id"]: r["s"] for r in find(docs(spark, rows)).select("doc_id", shown(F.col("all")).alias("s")).collect()}
    start = rows[-1][1].index("me9")
    assert found[9] == f"email:4:11,email:{start}:{start + 8}"


def test_right_contexts_and_secrets(spark):
    rows = [(k, f"w{'abcdefg'[k]} 10.0.{k}.7 (address) w", "s") for k in range(6)] + [(10, "wz fe80::1%eth0 (address) w", "s")]
    rows += [(20 + k, f'token = "{k + 1:040x}" is', "s") for k in range(10, 16)] + [(40, 'token = "Zk9-short" is', "s")]
    found = {r["doc_id"]: r["s"] for r in find(docs(spark, rows)).select("doc_id", shown(F.col("all")).alias("s")).collect()}
    assert found[10] == "ip:3:15" and found[30] == "secret:9:49" and found[40] == "secret:9:18"


HARD = [
    "a@b.c_d@e.f x@y.z@w.v", "user.name+tag@sub-domain.example.co.uk, a@b a@b. @c.d", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 5500 0000 0000 0004 1", "+1 (402) 555-1234 +12 ( x +49.30.1234567890123456",
    "é" * 5 + " 日本 a@b.cd 漢 10.0.0.1", "1" * 5000 + " " + "1 " * 3000, "+1" + "(" * 3000, "x" * 20_000 + "@y.zz", "a." * 5000, "\n10.0.0.1\na@b.cc\n", "+1234567890a@b.com",
]


def test_base_spans_equal_plain_matching(spark):
    rows = sample_rows() + [(600 + k, t, "s") for k, t in enumerate(HARD)]
    found = find(clashing(docs(spark, rows))).select("doc_id", shown(F.col("base")))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, plain(t)) for i, t, _ in rows), key=repr)


def test_all_base_spans_stay_and_counts(spark):
    rows = [(k, t, "s") for k, t in enumerate(HARD)]
    found = find(docs(spark, rows)).select("base", "all", *(counted(F.col("base"), k).alias(k) for k in KINDS)).collect()
    for r in found:
        assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["all"]}
    assert sum(r["email"] for r in found) == sum(plain(t).count("email") for t in HARD)
    assert find(docs(spark, [])).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"please write to my address: user{k}@mail.example.com thanks a lot", "s") for k in range(8)]
    rows += [(50 + k, f"please write to my address: user{k}[at]mail9 thanks a lot", "s") for k in range(2)]
    rows += [(70 + k, f"the model number item{k}00x is on sale now", "s") for k in range(8)]
    found = {r["doc_id"]: r["s"] for r in find(docs(spark, rows)).select("doc_id", shown(F.col("all")).alias("s")).collect()}
    assert found[50] == "email:28:42" and found[51] == "email:28:42"
    assert all(found[70 + k] == "" for k in range(8))
    assert all(found[k] == plain(t) for k, t, _ in rows[:8])


def test_redaction(spark):
    rows = [(1, "mail a@b.cc now from 10.0.0.1", "s"), (2, "none", "s"), (3, "+1234567890a@b.com!", "s")]
    found = find(docs(spark, rows)).join(docs(spark, rows).select("doc_id", "text"), "doc_id")
    assert records(found.select("doc_id", redacted(F.col("text"), F.col("all")).alias("t")), "doc_id", "t") == [
        (1, "mail [email] now from [ip]"), (2, "none"), (3, "[email]!"),
    ]


def test_plan_has_no_python(spark):
    plan = find(docs(spark, sample_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
