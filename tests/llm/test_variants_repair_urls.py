"""Spelling variants, conversation repair and URL filters against plain recomputation, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lokalith.llm import conversations, queries, spelling, urls

pytestmark = pytest.mark.filterwarnings("ignore")


# -- spelling ---------------------------------------------------------------------------------------------------------


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain_words(docs) -> Counter:
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += len(low) >= 7
    return n


def _plain_variants(n: dict[str, int]) -> set:
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and _near(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(x, key=lambda o: (-n[o], o)) for w, x in near.items() if x}
    form = {w: o for w, o in best.items() if n[o] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def _rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def test_spelling_query_equals_brute_force_on_whole_tables(spark, sf):
    docs = _rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    words = {w: n for w, n in _plain_words(docs).items() if n >= 2 and len(w) >= 7}
    wanted = _plain_variants(words)
    got = _rows(queries.op11_spelling_variants(spark, sf))
    assert len(got) == len(wanted) and set(got) == wanted
    assert sum(r[4] > 0 for r in got) > 100


@pytest.mark.parametrize("partition_words", [1, 3, 4096])
def test_near_pairs_of_crowded_words(spark, partition_words):
    rng = random.Random(partition_words)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(300)} | {"a" * k for k in range(1, 12)} | {"prefix" + x + "suffix" for x in ("", "a", "ab", "b", "bb", "abc")}
    words |= {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    vocabulary = spark.createDataFrame([(w,) for w in [*words, *list(words)[:5]]] + [(None,)], "word string")
    got = [frozenset((a, b)) for a, b in _rows(spelling.near_pairs(vocabulary, partition_words))]
    wanted = {frozenset((a, b)) for a, b in itertools.combinations(words, 2) if abs(len(a) - len(b)) < 2 and _near(a, b)}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_forms_follow_to_the_last_and_ties_go_to_the_smallest(spark):
    n = {"colours": 2, "colour": 20, "color": 200, "colors": 200, "colorz": 2000, "aaaaaaa": 5, "aaaaaab": 50, "aaaaaac": 50, "zzzzzzz": 9}
    got = _rows(spelling.variants(spark.createDataFrame([(w, k, "extra") for w, k in n.items()], "word string, n long, form string"), partition_words=1))
    assert set(got) == _plain_variants(n)
    assert next(r for r in got if r[0] == "colours")[2] == "colorz"


def test_spelling_edges(spark):
    docs = spark.createDataFrame([(None, "Ähnlich ähnlich Ähnliches"), (1, None), (2, ""), (3, "A" * 20000), (3, "A" * 20000), (4, "straße÷straße")], "doc_id long, text string")
    words = {w: n for w, n in _plain_words([tuple(r) for r in docs.collect()]).items() if len(w) >= 7}
    assert dict(_rows(spelling.planted_words(docs))) == words
    clashing = docs.selectExpr("doc_id", "text", "1 as word", "2 as n", "3 as h", "4 as run")
    assert dict(_rows(spelling.planted_words(clashing))) == words
    assert _rows(spelling.variants(spelling.planted_words(docs.limit(0)))) == []


# -- conversations ----------------------------------------------------------------------------------------------------


def _plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        f = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if f == 0:
            continue
        if f in (1, 2):
            text = "" if f == 1 else re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def _plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return faults


def _plain_repair(rows, faults):
    """Every combination of edits, tried by a queue in the order of cost and labels; no automata."""
    import heapq

    heap, least = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, "\n".join(out)
        if cost > least.setdefault((i, initials[-1:]), cost):  # a cheapest whole begins with a cheapest part
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, out))
            if faults[i] in (None, "truncated"):
                more = 5 if faults[i] else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + (role[:1] or "-"), (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, initials + new[0], (*out, f"{new}:{text}")))


def _plain_report(rows):
    out = set()
    made = _plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted([r[1:] for r in made if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = _plain_faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = _plain_repair(own, faults)
        out.add((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def test_repair_query_equals_a_search_of_all_edits(spark, sf):
    rows = _rows(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    got = _rows(queries.op12_conversation_repair(spark, sf))
    assert len(got) == len(set(got)) == len({r[0] for r in rows}) and set(got) == _plain_report(rows)
    assert any("D" in r[7] for r in got)


@pytest.mark.parametrize("fragment", [1, 2, 512])
def test_repair_of_odd_conversations(spark, monkeypatch, fragment):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Hi.", "What?", "cut off", "", " \t\n", None, "Well!", "é.", "Hi."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 7))]
    rows += rows[:40]
    rows += [(900, 3, "user", "same."), (901, None, None, None), (902, -5, "assistant", "x" * 30000)]
    monkeypatch.setattr(conversations, "FRAGMENT_ROWS", fragment)
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")
    # rows that are equal are told by their number only, so the copies a fault 3 makes of them are adjacent too
    got = _rows(conversations.whole_report(table, conversations.damaged(table)))
    assert set(got) == _plain_report(rows)


def test_long_conversation_is_cut_and_joined_again(spark, monkeypatch):
    rows = [(5, t, ("user", "assistant")[t % 3 % 2], f"line {t}" + ("." if t % 11 else "")) for t in range(2500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = [(r[2], r[3]) for r in rows]
    faults = _plain_faults([r[1:] for r in rows])
    cost, path = conversations.joined_path([conversations.fragment_weights([(r, f) for (r, _), f in zip(whole, faults, strict=True)])])
    monkeypatch.setattr(conversations, "FRAGMENT_ROWS", 100)
    report, repaired = conversations.repair(conversations.messages(table))
    assert [(r.cost, r.audit) for r in report.collect()] == [(cost, "".join(x for _, x in path))]
    parts = sorted((r.part, r.seq, r.messages) for r in repaired.collect())
    assert len(parts) >= 25
    initials = "".join(m.role[0] for _, _, own in parts for m in own)
    assert re.fullmatch("s?(ua)+", initials) and len(initials) == sum(x in "KRI" for x in "".join(x for _, x in path))


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert _rows(conversations.whole_report(empty, conversations.damaged(empty))) == []


# -- URLs -------------------------------------------------------------------------------------------------------------

ODD = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en/1", "http://www.example.com/en/1?x#y", "http://notexample.com/en/1", "https://a.b.net/es/", "https://net/fr/x",
    "https://x.net/ES/", "HTTP://Adult-X.example.org/", "http://a.org/wp-login.php", "http://a.org/wp-login.php?action=help", "http://a.org/x.EXE", "ftp://a.org/f", "http://a.org/?phpsessid=1",
    "http://a.org/cgi-bin/a?b=c", "http://casino.a.org/x/history/y", "http://casino.a.org/x", "http://é.com/x", "a://b://c.net/es/", "http://user:pw@example.com:80/en/", "http://example.com/en/" + "z" * 50000,
    "http://a.org/x.exe\n", "http://notadult-x.org/", "http://x/?u=http://adult-x.org/",
]


def _plain_verdict(url, sites, patterns):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(rule, v) for rule, v in sites if ("." + host).endswith("." + rule.split("/")[0]) and path.startswith(rule[rule.index("/") :])]
    low = (url or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = [(v, p) for p, v in patterns if re.search(urls.pattern_regex(p), low)]
    if fits:
        rule, verdict = min(fits, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0]))
        return host, path, rule, verdict, None
    return host, path, None, min(found)[0] if found else "allow", min(found)[1] if found else None


@pytest.mark.parametrize("broadcast_bytes", [urls.BROADCAST_BYTES, 0])
def test_urls_by_broadcast_and_by_join_equal_trying_every_rule(spark, sf, broadcast_bytes):
    table = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-n, u) for n, u in enumerate([*ODD, *ODD[:4]])], "page_id long, url string")
    pages = table.unionByName(odd)
    got = _rows(urls.judge(pages, urls.rules_of(spark, queries.SITES), broadcast_bytes=broadcast_bytes))
    wanted = [(i, u, *_plain_verdict(u, queries.SITES, urls.PATTERNS)) for i, u in _rows(pages)]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert {r[5] for r in got} == {"allow", "block"} and any(r[6] for r in got)


def test_only_rules_of_a_token_of_the_url_are_candidates():
    assert urls.literal_tokens("||spam-farm.") == ["farm", "spam"]
    assert urls.literal_tokens("banner*ads^") == [] and urls.literal_tokens("^ads^banner") == ["ads"]
    assert urls.literal_tokens("|ftp://") == ["ftp"] and urls.literal_tokens(".exe|") == ["exe"]
    assert urls.literal_tokens("www.example.com/en", site=True) == ["com", "example", "www"]
    with pytest.raises(ValueError):
        urls.site_regex("example.com")


def test_rarest_token_is_the_index(spark):
    pages = spark.createDataFrame([("http://www.example.com/a",), ("http://www.example.com/b",), ("http://www.rare.com/",)], "url string")
    rules = urls.compiled(urls.rules_of(spark, [("www.rare.com/", "block"), ("com/", "allow")], [("*banner*", "block")]))
    assert dict(_rows(urls.indexed(rules, pages).select("rule", "token"))) == {"www.rare.com/": "rare", "com/": "com", "*banner*": ""}


def test_url_edges(spark):
    none = urls.rules_of(spark, [], [])
    pages = spark.createDataFrame([(1, None, "own", "x"), (1, None, "own", "x")], "page_id long, url string, rule string, other string")
    got = urls.judge(pages, none)
    assert got.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict", "pattern"]
    assert _rows(got) == [(1, None, "x", "", "", None, "allow", None)] * 2
    assert _rows(urls.judge(pages.limit(0), urls.rules_of(spark, queries.SITES))) == []


# -- what was cut off before ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("inserted", [0, 6, 7, 20, 100])
def test_license_with_inserted_words_is_one_match(spark, inserted):
    from lokalith.llm import licenses

    name = max((n for n in licenses.TEMPLATES), key=lambda n: len(licenses.TEMPLATES[n]))
    words = licenses.TEMPLATES[name].split()
    half = len(words) // 2
    text = "before it " + " ".join([*words[:half], *(f"foreign{k}" for k in range(inserted)), *words[half:]]) + " behind it"
    found = [r for r in licenses.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() if r["template"] == name]
    assert len(found) == 1 and found[0]["coverage"] == 1.0
    assert text[found[0]["start_char"] : found[0]["end_char"]].split()[0] == words[0] and text[: found[0]["end_char"]].endswith(words[-1].rstrip(".>"))


def test_copies_of_a_license_stay_apart_and_no_templates_are_none(spark):
    from lokalith.llm import licenses

    name = max((n for n in licenses.TEMPLATES), key=lambda n: len(licenses.TEMPLATES[n]))
    text = " and ".join([licenses.TEMPLATES[name]] * 3)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sum(r["template"] == name and r["coverage"] == 1.0 for r in licenses.license_spans(df).collect()) == 3
    assert licenses.license_spans(df, templates={}).count() == 0


def test_rare_languages_are_learned_too(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lokalith.llm import langid

    monkeypatch.setattr(langid, "ALL_ROWS", 40)
    rows = [(k, f"{chr(97 + n // 26)}{chr(97 + n % 26)}{chr(97 + n // 26)}" * 20 + f" {k}", f"l{n:03}") for k, n in enumerate([n for n in range(60) for _ in range(1 if n > 50 else 9)])]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model) >= 55 and {f"l{n:03}" for n in range(51, 60)} <= set(model)
