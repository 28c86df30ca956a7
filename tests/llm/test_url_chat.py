"""URL rules and model, chat rendering: hard cases; the queries against SQL."""

import hashlib
import re

import pytest
from llm_fixtures import HARD_TEXTS, SF0001, long_text  # noqa: F401
from oracle import compare, duck
from pyspark.sql import functions as F

from eventlens.llm import chat, url_model
from eventlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_small_table_matches_sql(spark, name):
    assert not compare(QUERIES[name](spark, SF0001), duck(SF0001), ORACLES[name])


URLS = {
    None: ("", "", None), "": ("", "", None), "no scheme.com/x": ("", "", None), "http://": ("", "", None), "http://A.COM": ("a.com", "", None),
    "http://A.com/": ("a.com", "/", "com/"), "https://x.example.com/en/1?q=/fr/": ("x.example.com", "/en/1", "example.com/en/"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"), "https://a.www.example.com/en/1#x": ("a.www.example.com", "/en/1", "www.example.com/en/"),
    "https://notexample.com/en/": ("notexample.com", "/en/", "com/"), "ftp://b.net/es/x": ("b.net", "/es/x", "net/es/"), "http://b.net/EN/": ("b.net", "/EN/", None),
    "http://net/fr/": ("net", "/fr/", "net/fr/"), "http://x.net?a=/fr/": ("x.net", "", None), "x://y://z.com/": ("y:", "//z.com/", None), "http://com/q#://net/es/": ("com", "/q", "com/"),
    "http://É.com/ü": ("É.com", "/ü", "com/"), "http://a.com:80/": ("a.com:80", "/", None), "line\nhttp://n.com/\nx": ("n.com", "/\nx", "com/"),
}


def test_hosts_paths_rules(spark):
    rows = list(enumerate(URLS)) * 2
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = url_model.judge_urls(df).collect()
    assert len(got) == len(rows)
    allow = dict(url_model.RULES)
    for r in got:
        url = rows[r.page_id][1]
        assert (r.host, r.path, r.rule) == URLS[url], url
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == allow[r.rule])
        if not url:
            assert r.verdict == "block" and r.score_bin is None


def test_no_pages_and_one_class(spark, long_text):
    schema = "page_id long, url string"
    assert url_model.judge_urls(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/" + long_text[:50_000]), (None, "http://b.org/")], schema)
    assert sorted((r.page_id is None, r.verdict) for r in url_model.judge_urls(df).collect())[0][1] in ("allow", "block")


def test_model_tells_the_classes_apart(spark):
    """Held-out accuracy: hosts of one kind are accepted by rule, others rejected; unruled ones look like either."""
    words = ["alpha", "bravo", "delta", "gamma"]
    bad = ["xqz", "zzk", "qqx", "kzq"]
    rows, truth = [], {}
    for i in range(400):
        kind = i % 2
        w = (words if kind else bad)[i // 2 % 4]
        top = ["com/", "org/"][i // 8 % 2] if kind else ["net/es/", "org/"][i // 8 % 2]
        rows.append((i, f"http://{w}{i * 7 % 97}.{top}{w}/{i}"))
        truth[i] = "allow" if kind else "block"
    got = {r.page_id: r for r in url_model.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    free = [i for i in got if got[i].rule is None]
    assert len(free) > 150 and sum(got[i].verdict == truth[i] for i in free) >= 0.97 * len(free)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip_of_hard_texts(spark, long_text):
    hard = ["\\### Assistant: </turn> ok", "</turn>", "</turn>\n### User: x", "\\", "\\\\", "ends with \\", "### ", "#### x", "a: b", ": ", "<\\/turn>", "</tur", "n>", "#\\## ", "\\n",
            "</turn></turn>", "\n### Assistant: me", *[t for t in HARD_TEXTS], long_text + "</turn>\\", "\\" * 5000, "</turn>" * 2000]
    roles = ["user", "assistant", "system", "x: y", "### ", "</turn>", "", None, "a\\: b", "ends\\"]
    rows = [(i, k, roles[(i + k) % len(roles)], hard[(i + 3 * k) % len(hard)]) for i in range(len(hard)) for k in range(4)]
    rows += [(None, 0, "user", "hi"), (None, None, "assistant", None), (999, 5, "user", "same"), (999, 5, "user", "same"), (999, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("z")).withColumn("level", F.lit(9))
    got = chat.format_conversations(df).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()
    source = {}
    for c, t, r, x in rows:
        source.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(got) == len(source)
    for g in got:
        turns = [(r, x) for _, _, r, x in sorted(source[g.conv_id], key=lambda s: (s[0], s[1], s[2].encode(), s[3].encode()))]
        assert g.round_trip and [(p.role, p.text) for p in g.parsed] == turns
        assert list(g.loss) == [x for r, x in turns if r == "assistant"]
        marks = re.findall(r"</turn>", g.formatted)
        assert len(marks) == len(turns)
    assert chat.format_conversations(spark.createDataFrame([], df.schema)).count() == 0


def test_plain_texts_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello <b> # there"), (1, 1, "assistant", "fine: thanks")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "### user: hello <b> # there</turn>\n### assistant: fine: thanks</turn>\n"
    levels = [r.level for r in chat.format_turns(df.union(spark.createDataFrame([(2, 0, "user", "a\\b"), (2, 1, "user", "</turn>")], df.schema))).orderBy("conv_id", "turn").collect()]
    assert levels == [0, 0, 1, 2]


def test_each_level_is_chosen_by_reparsing(spark):
    parts = ["a", "\\", "</turn>", "### ", ": ", "\n", "</tur", "n>", "#", " ", "", "<\\/turn>"]
    rows = [(k, 0, parts[k // 7 % 12] + parts[k % 12], "".join(parts[(k * m + m) % 12] for m in (1, 5, 7, 11))) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    t = chat.format_turns(df)
    for k in range(chat.LEVELS):
        t = t.withColumn(f"read{k}", chat.parse(chat.render(F.col("role"), F.col("text"), k))).withColumn(f"shown{k}", F.contains(chat.escape(F.col("text"), k), F.lit("### ")) | F.contains(chat.escape(F.col("role"), k, True), F.lit("### ")))
    levels = set()
    for r in t.withColumn("back", chat.parse(F.col("rendered"))).collect():
        assert [tuple(x) for x in r.back] == [(r.role, r.text)]
        good = [[tuple(x) for x in r[f"read{k}"]] == [(r.role, r.text)] and not r[f"shown{k}"] for k in range(chat.LEVELS)]
        assert r.level == good.index(True)
        levels.add(r.level)
    assert levels == {0, 1, 2}


def test_special_conversation_of_the_query(spark):
    r = QUERIES["op6_chat_round_trip"](spark, SF0001).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.turns_sha256) == (2, digest([("user", text), ("assistant", text)]))
    assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
