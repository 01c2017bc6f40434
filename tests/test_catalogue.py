"""Each query of the text library against its SQL, and the literal cases of the cleaning and segmentation rules."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import chapters as CH
from quire.operators.clean import CleanOptions, clean_text
from quire.operators.progress import Limiter
from quire.plans import catalogue, lifecycle  # noqa: F401  registers its queries too
from quire.sources.encoding import detect


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(name, spark, sf, duck, rows_of):
    got = rows_of(catalogue.QUERIES[name](spark, sf))
    if name in catalogue.ORACLES:
        assert got == duck(catalogue.ORACLES[name])
    else:
        assert got[1]


def cleaned(spark, text, **options):
    return spark.range(1).select(clean_text(F.lit(text), CleanOptions(**options))).first()[0]


@pytest.mark.parametrize("text, want, options", [
    ("[12]你好【3】世界\n\n\n\n第二段来了。", "你好世界\n第二段来了。", {}),
    ("他走进房间然后\n坐下说话。", "他走进房间然后坐下说话。", {"join_soft": True}),
    ("an end\nand on", "an end and on", {"join_soft": True}),
    ("他说「今天好冷」然后走了。", "他说“今天好冷”然后走了。", {"unify_quotes": True}),
    ("前文\nhttps://www.a.com/b\n【笔趣阁 手机阅读】\n后文", "前文\n后文", {}),
    ("# 标题\n1. 初见\n- 项目 **重点** *斜*", "标题\n1. 初见\n项目 重点 斜", {}),
    ("naïve 😀 a", "nave a", {}),
    ("a\n\n\nb", "a\n\nb", {"collapse_blank": False}),
    ("a\nb", "　　a\n　　b", {"indent": True}),
    (None, "", {}), ("", "", {}),
])
def test_cleaning(spark, text, want, options):
    assert cleaned(spark, text, **options) == want


def split(spark, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    r = CH.split_chapters(df, **options).select("rule", "chapters").first()
    return r.rule, [tuple(c) for c in r.chapters]


def test_segmentation(spark):
    assert split(spark, "引子段落……\n第一章 相遇\n他醒了。\n第二章 离别\n她走了。") == ("cn", [("引子", "引子段落……"), ("第一章 相遇", "他醒了。"), ("第二章 离别", "她走了。")])
    assert split(spark, "第一章　风起\na\n第二章：新的开始\nb")[1] == [("第一章 风起", "a"), ("第二章：新的开始", "b")]
    assert split(spark, "第一章\n正文一\n第二章\n正文二")[1] == [("第一章", "正文一"), ("第二章", "正文二")]
    assert split(spark, "第一回 甲\na\n第二回 乙\nb")[0] == "cn_hui"
    assert split(spark, "Chapter 1 One\na\nCHAPTER II Two\nb")[0] == "en"
    assert split(spark, "没有章节的文本", fallback=F.lit("书名")) == (None, [("书名", "没有章节的文本")])
    assert split(spark, "") == (None, []) == split(spark, None)
    assert split(spark, "第一章 甲\n第二章 乙\n") == (None, [("正文", "第一章 甲\n第二章 乙")])
    assert split(spark, "a\nb", pattern="none")[0] == "none"


def test_custom_and_unknown_rules(spark):
    """A blank or invalid expression leaves the text whole; an unknown name takes the first rule."""
    text = "第一章 甲\n正文一。\n第二章 乙\n正文二。"
    for bad in ("", " ", "(第", "(第[章"):
        assert split(spark, text, pattern="custom", custom=bad) == (None, [("第一章 甲", text)])
    assert split(spark, text, pattern="custom", custom="^第(.)章") == ("custom", [("一", "甲\n正文一。"), ("二", "乙\n正文二。")])
    assert split(spark, text, pattern="custom", custom="^正文.")[1] == [("引子", "第一章 甲"), ("", "。\n第二章 乙"), ("", "。")]
    assert split(spark, text, pattern="custom", custom="xyz") == (None, [("正文", text)]) == split(spark, text, pattern="nope")
    assert split(spark, "第一回 甲\na\n第二回 乙\nb", pattern="nope") == ("nope", [("第一回 甲", "a"), ("第二回 乙", "b")])


def reference_lines(text, site=True, soft=False, collapse=True, indent=False):
    """The rules for lines, one line after the other."""
    ws = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    ls = [re.sub("[\t \u3000]+", " ", x).strip(ws) for x in text.split("\n")]
    if site:
        url = lambda x: len(x) <= 100 and (re.match(r"(?i)(?:\s*[【\[（(《<]?[^】\]）)》<>\s]{0,12}[】\]）)》>]?\s*)?(?:https?://|www\.)\S+\Z", x) or (
            (m := re.match(r"(?i)(?:https?://|www\.)\S+(?:\s+(\S.*))?\Z", x)) and len((m[1] or "").strip()) <= 8 and not re.search("[，。！？、；：\"'（）【】]", m[1] or "")))
        named = lambda x: len(x) <= 40 and (re.match(r"[【\[（(][^】\]）)]{0,30}(?:笔趣阁|手机|本书)[^】\]）)]{0,30}[】\]）)]?\Z", x) or re.match("本书(?:来自|由)|首发于", x))
        ls = [x for x in ls if not x or not (url(x) or named(x) or re.match(r"={3,}\s*(?:完|全文完)", x))]
    if soft:
        out, buf = [], ""
        for x in [*ls, ""]:
            if not x or not buf or buf[-1] in "。！？!?…：；;:\"'「『（(《—":
                out, buf = (out + [buf] if buf else out), x
            else:
                buf += (" " if re.search("[A-Za-z0-9]\\Z", buf) and re.match("[A-Za-z0-9]", x) else "") + x
        ls = out
    ls = [x for i, x in enumerate(ls) if x or not (collapse or (i and not ls[i - 1]))]
    return "\n".join("\u3000\u3000" + x if indent and x else x for x in ls).strip("\n")


@pytest.mark.parametrize("options", [{}, {"join_soft": True}, {"collapse_blank": False}, {"indent": True, "strip_site": False}, {"join_soft": True, "collapse_blank": False}])
def test_rules_for_lines(spark, options):
    r = random.Random(11)
    parts = ["a", "b1", " ", "\t", "\u3000", "\n", "\n\n", "\u00a0", "。", "https://x.y", "www.z", "【", "】", "笔趣阁", "本书来自", "=== 完", "汉字", ", ", "\u2003 ", "第", "x" * 30]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(map(tuple, df.select("i", clean_text(F.col("t"), CleanOptions(strip_ref_marks=False, strip_markdown=False, clean_garbled=False, **options))).collect()))
    for i, t in enumerate(texts):
        assert got[i] == reference_lines(t, options.get("strip_site", True), options.get("join_soft", False), options.get("collapse_blank", True), options.get("indent", False)), repr(t)


def test_long_texts_take_linear_time(spark):
    text = "一行文字，不长不短。\n\n" * 100_000 + "\u00a0" * 200_000 + "x"
    for options in ({}, {"join_soft": True}, {"collapse_blank": False, "clean_garbled": False}):
        began = time.time()
        assert cleaned(spark, text, **options).count("一行") == 100_000
        assert time.time() - began < 10
    began = time.time()
    rule, found = split(spark, "".join(f"第{i}章 甲\n正文{i}。\n" for i in range(20_000)))
    assert rule == "cn" and len(found) == 20_000 and time.time() - began < 20


def test_fit_cuts_between_characters(spark):
    text = "汉字a😀" * 50
    rows = spark.createDataFrame([(1, 0, "t", text)], "id long, pos int, title string, content string")
    parts = CH.fit_chapters(rows, "id", most=101).orderBy("part").collect()
    assert "".join(p.content for p in parts) == text and max(len(p.content.encode()) for p in parts) <= 101 and parts[0].title == "t（1）"


def test_encodings():
    assert detect("第一章测试".encode("gb18030"))[:2] == ("gb18030", "第一章测试")
    assert detect(b"\xef\xbb\xbfabc") == ("utf-8", "abc", 0)
    assert detect("﻿他们来了".encode("utf-16-le"))[:2] == ("utf-16le", "他们来了")
    assert detect(b"plain")[0] == "utf-8" and detect(None) == ("utf-8", "", 0)


def test_limiter_locks_doubles_and_clears():
    m = Limiter(limit=2, lock=100, most=1000, window=10_000)
    assert [m.attempt(t, True)[0] for t in (1, 2, 3, 50)] == [False, False, True, True]
    assert m.attempt(103, True) == (False, 0) and m.attempt(104, True) == (False, 304)
    assert m.attempt(200, False)[0] and m.attempt(305, False) == (False, 0) and m.state() == (0, 0, 0, 0)


def test_limiter_query_folds_all_events(spark, tmp_path):
    """The reference's rules, one event after the other: a success clears a user's record, but not while it is locked."""
    day, rng, rows = 86_400_000, random.Random(2), []
    for i in range(600):
        rows.append((i, i % 4, 1_700_000_000_000 + i * day // 8 + rng.randrange(day), rng.choices(["error", "view", None], [8, 1, 1])[0]))
    spark.createDataFrame(rows, "event_id long, user_id long, ms long, event_type string").selectExpr(
        "event_id", "user_id", "timestamp_millis(ms) AS ts", "1.0D AS value", "'{}' AS props", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    want, held = [], {}
    for seq, user, now, kind in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        rec = held.get(user, {"fail": 0, "until": 0, "strikes": 0, "at": 0})
        if rec["until"] > now:
            want.append((user, seq, True, rec["until"]))
            continue
        if kind != "error":
            held.pop(user, None)
            want.append((user, seq, False, 0))
            continue
        if rec["until"] or now - rec["at"] > 5 * day:
            rec.update(fail=0, until=0)
        rec.update(fail=rec["fail"] + 1, at=now)
        if rec["fail"] >= 3:
            rec.update(strikes=rec["strikes"] + 1, fail=0)
            rec["until"] = now + min(2 * day * 2 ** (rec["strikes"] - 1), 16 * day)
        held[user] = rec
        want.append((user, seq, False, rec["until"]))
    assert any(w[2] for w in want) and len(want) == 600
    assert sorted(map(tuple, catalogue.QUERIES["limiter"](spark, str(tmp_path)).collect())) == sorted(want)


def test_readability_of_whole_texts(spark, tmp_path):
    """A character beyond the first 20 counts, for an even doc_id too."""
    rows = [(i, "a" * 100 + "\ufffd" * i) for i in (2, 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, catalogue.QUERIES["readability_whole"](spark, str(tmp_path)).collect()))
    x = "的一是㐀人\uf900他\ufffd龥" + rows[0][1]
    assert got == {2: round(6 / len(x) * 100 + 0.5 * 5 - 60 * 3 - 10 * 2, 6), 3: -180.0}


def test_all_books_are_in_the_trash(spark, sf):
    books = spark.read.parquet(f"{sf}/part.parquet").count()
    got = catalogue.QUERIES["trash_view_all"](spark, sf).collect()
    assert len(got) == books > 20 and {r.expired for r in got} == {True, False} and max(r.id for r in got) > 20


def test_whole_texts_are_decoded(spark, tmp_path):
    """Texts longer than the sample too, with a character of two bytes across its border."""
    rows = [(1, t, x) for t, x in enumerate(["plain", None, "他们来了" * 30_000, "x" + "春天来了" * 30_000 + "end"])]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: (r.encoding, r.replaced, r.text) for r in catalogue.QUERIES["detect_encoding_texts"](spark, str(tmp_path)).collect()}
    assert got == {t: ("gb18030", 0, "的一是在不了有和人这中大为上个国我以要他" + (x or "")) for _, t, x in rows}


def test_letters_in_pairs_are_no_utf16(spark, tmp_path):
    """Accents of two bytes between letters, a line feed and characters of four bytes: UTF-16 would read most pairs as Han characters."""
    texts = ["Y para jamente conñarbomente. El cicióní ñcióngall de ueó tamenteó elosbora esdouear mentearco.", "Und chpfte einheitlich stpf zuchätzer enchver bersch geöer schbertz.",
             "Íque se ciónasos, ciónllco.\nCiónos ierr quebo ez de ciónll de dora la ciónquegaue osrrbo ar ñadobo.", "丂丄丅丆丏丒丗丟" * 20, "\U0001f600 ok " * 50]
    rows = [(1, t, x) for t, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: (r.encoding, r.replaced, r.text) for r in catalogue.QUERIES["detect_encoding_texts"](spark, str(tmp_path)).collect()}
    assert got == {t: ("gb18030", 0, "的一是在不了有和人这中大为上个国我以要他" + x) for _, t, x in rows}


@pytest.mark.parametrize("text", ["第一章 相遇\n他醒了。\n第二章 离别\n她走了。", "他们来了" * 3, "他们来了" * 30_000, "春天來了他們在這裡生活", "這個國家，來了人。" * 20 + "ok"])
def test_utf16_without_a_mark(text):
    for name in ("utf-16-le", "utf-16-be"):
        assert detect(text.encode(name)) == (name.replace("utf-16-", "utf-16"), text, 0)
