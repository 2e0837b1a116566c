import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from spanveil.llm.line_dedup import drop_lines
from spanveil.llm.personal_data import detect

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 * (c > "4") if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for kind, p in KINDS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def brute_secrets(text, base):
    out = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", text) if m.end() - m.start() >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return [x for x in out if not any(s < x[1] and x[0] < e for _, s, e, _ in base)]


def brute_terms(texts, share, support, reach=60):
    texts = sorted(set(texts))
    base = {t: brute_base(t) for t in texts}
    secrets = {t: brute_secrets(t, base[t]) for t in texts}
    near, with_entity, with_term = defaultdict(set), defaultdict(set), Counter()
    for t in texts:
        with_term.update({w.lower() for w in re.findall(r"\w+", t)})
        for kind, s, e, v in base[t] + [("secret", s, e, t[s:e]) for s, e in secrets[t]]:
            d = re.sub("[^0-9]", "", v)
            exact = {"card": d, "phone": d, "secret": v}.get(kind, v.lower())
            group = {"email": v.lower().rsplit("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:4], "secret": len(v)}[kind]
            lo, hi = t.rfind("\n", 0, s) + 1, t.find("\n", e) if "\n" in t[e:] else len(t)
            for entity in ((kind, 1, exact), (kind, 2, group), (kind, 3)):
                with_entity[entity].add(t)
                for m in re.finditer(r"\w+", t):
                    left = lo <= m.start() and m.end() < s and (m.start() > s - reach or s <= reach or lo > s - reach) and m.start() >= s - reach
                    right = m.start() > e and m.end() <= hi and (m.end() < e + reach or (m.end() <= e + reach and len(t) <= e + reach))
                    if left or right:
                        near[entity, m[0].lower()].add(t)
    n = len(texts)
    telling = {w for (entity, w), where in near.items() if len(where) >= support and math.log2(len(where) * n / (with_term[w] * len(with_entity[entity]))) >= share * math.log2(n / len(with_entity[entity]))}
    out = {}
    for t in texts:
        taken = [(s, e) for _, s, e, _ in base[t]] + secrets[t]
        out[t] = [(m.start(), m.end()) for m in re.finditer(r"\w+", t) if m[0].lower() in telling and not any(s < m.end() and m.start() < e for s, e in taken)]
    return out


def texts():
    rng = random.Random(4)
    words = "alpha beta gamma delta Épsilon zeta eta theta 𝄞x iota".split()
    hits = ["a@b.co", "a@b.c_d@e.f", "x..y@-a.b-c.d", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.003.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 22", "+1 (555) 123-4567", "+49 30 1", "+1", "@", "a@", "12 3", "9999999999999995", "+12345678", "1.2.3"]
    out = []
    for _ in range(150):
        out.append(rng.choice([" ", "\n", ", "]).join(rng.choice(words + hits) for _ in range(rng.randint(0, 30))))
    for i in range(6):
        out.append(f"lead{i} see secretword{i % 2} near who@corp.example now {i} " + " ".join(rng.choice(words) for _ in range(5)))
        out.append(f"Key{'' if i else 's'} token = {'ab12' * 6}{i} end {rng.choice(words)}, netword 10.7.{i}.9 far\nbut x12" + "y" * 30)
    out += ["a token and Secretword1 elsewhere", "q" * 30 + " and " + "7" * 30]
    return sorted(set(out))


def test_personal_data_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, spans string").repartition(2)
    terms = brute_terms(rows, 0.8, 3)
    assert sum(len(v) for v in terms.values()) >= 3
    for r in detect(df, share=0.8, support=3).collect():
        t = rows[r.doc_id]
        base = brute_base(t)
        want = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in KINDS)
        secrets = brute_secrets(t, base)
        assert r.spans == ",".join([*([want] if want else []), *(f"secret:{s}:{e}" for s, e in secrets), *(f"term:{s}:{e}" for s, e in terms[t])])
        assert (r.n_secret, r.n_term, r.n_spans) == (len(secrets), len(terms[t]), len(base) + len(secrets) + len(terms[t]))
        if not r.n_spans:
            assert r.clean_text == t
        assert not any(v in r.clean_text for k, _, _, v in base if k == "email")


def test_personal_data_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co"), (4, "1" * 30000 + " " + "a" * 30000 + " " + "1 " * 20000), (5, "x@" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in detect(df, keep_text=False).collect()}
    assert len(got) == 6 and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_email == 1 and got[4].n_card == 0
    assert detect(df.limit(0)).collect() == []


def brute_lines(rows, min_docs=10, weight=40):
    def keys(line):
        tokens = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
        n = len(tokens)
        if n == 0:
            return []
        whole = (n, 0, max(2, -(-weight // n)), tuple(tokens))
        if n < 8:
            return [whole]
        a, b = (n - 3) // 3 + 3, 2 * (n - 3) // 3 + 3
        return [whole, *((n, i, min_docs, tuple(tokens[:3]), tuple(x), tuple(y)) for i, x, y in ((1, tokens[a:b], tokens[b:]), (2, tokens[3:a], tokens[b:]), (3, tokens[3:a], tokens[a:b])))]

    where = defaultdict(set)
    for _, t in rows:
        for line in (t or "").split("\n"):
            for k in keys(line):
                where[k].add(t)
    first = {t: min(i for i, x in rows if x == t) for _, t in rows}
    stays = {k: min(ts, key=first.get) for k, ts in where.items() if len(ts) >= k[2]}
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not any(k in stays and stays[k] != t for k in keys(x))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.6:
            lines.insert(rng.randint(0, len(lines)), f"User {rng.choice(words)}{i} logged in from host {rng.choice(words)} at noon today")
        if rng.random() < 0.4:
            lines.append("Copyright 20%02d all rights" % i)
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200, ""), (201, "\n\n"), (202, None), (203, "  \t padded\t  line \r\n x\x0b\n\n ")]
    rows += [(300 + i, f"\tpadded line\n{i} only {'y' * i}\nEnd.") for i in range(30)]
    rows += [(400 + i, " ".join(["the same long passage of text"] * 10) + f"\nnumber {i}{i} z") for i in range(2)]
    rows += rows[20:24]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_lines int").repartition(3)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "", r.text is None) for r in drop_lines(df, min_docs=5, weight=30).collect())
    want = brute_lines(rows, 5, 30)
    assert got == sorted((i, n, d, t or "", t is None) for i, n, d, t in want) and sum(x[2] for x in want) > 60


def test_line_dedup_edges(spark):
    t = "a b c d e\nunique line one two three"
    df = spark.createDataFrame([(None, t), (1, None), (2, t + "\nx"), (2, t + "\ny")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in drop_lines(df, min_docs=3, weight=15).collect())
    assert got == [("1", None, 0), ("2", "x", 2), ("2", "y", 2), ("None", t, 0)]
    assert drop_lines(df.limit(0)).collect() == []
    long = "word " * 60_000 + "\n" + "9" * 100_000 + "\n" + "a9" * 50_000
    clash = spark.createDataFrame([(i, long if i < 2 else long + f"\n{i}", 1, 2, 3, "k", i) for i in range(3)], "doc_id long, text string, _gone int, _th int, th int, row string, `a.b` long")
    out = drop_lines(clash)
    assert out.columns == [*clash.columns, "n_lines", "n_dropped"]
    got = sorted((r.doc_id, r.text, r._gone, r._th, r.th, r.row, r["a.b"]) for r in out.collect())
    assert got == [(0, long, 1, 2, 3, "k", 0), (1, long, 1, 2, 3, "k", 1), (2, "9" * 100_000 + "\n" + "a9" * 50_000 + "\n2", 1, 2, 3, "k", 2)]


def test_copies_count_once_in_all_counts(spark):
    rows = [f"x{i} secretword who@corp.example" for i in range(3)] + [f"filler{i} only" for i in range(20)] + ["secretword elsewhere"]
    spans = lambda texts: {r.doc_id: r.spans for r in detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), share=0.8, keep_text=False).collect()}
    once, often = spans(rows), spans(rows + [rows[-1]] * 29)
    assert once[0] == "email:14:30,term:3:13" and once[23] == "term:0:10"
    assert {i: often[i] for i in once} == once


def test_terms_are_found_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = detect(docs, keep_text=False).agg({"n_secret": "sum", "n_term": "sum"}).first()
    assert got[0] > 10 and got[1] > 10
