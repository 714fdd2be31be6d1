import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from noticeloom.functions import facts, text as tx, urls
from noticeloom.operators import checks, collection
from noticeloom.operators.runner import Replay, apply_runner, complete_json
from noticeloom.sources import containers
from noticeloom.sources.html import page_parts
from noticeloom.streaming.jobs import JOB, run_jobs


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("url", "tier"),
    [("https://city.go.kr/n/1", "tier1"), ("https://citygo.kr", "tier2"), ("https://news.semas.or.kr:443/", "tier1"), ("http://192.168.0.9/a", "tier3"), ("https://semas.or.kr:81/", "tier3"), ("https://m.xn--o79a.kr", "tier3"), ("https://semass.kr/", "tier3"), ("https://shop.example", "tier2"), ("no address", "tier3"), (None, "tier3")],
)
def test_tier(spark, url, tier):
    assert one(spark, url, urls.tier) == tier


def test_urls(spark):
    assert one(spark, " a.kr/x?b=1&amp;c=2 ", urls.repaired) == "https://a.kr/x?b=1&c=2"
    assert one(spark, "www.a.go.kr", urls.registrable) == "a.go.kr"
    assert [one(spark, u, urls.blocked) for u in ("http://127.0.0.1/", "https://a.internal", "ftp://a.kr", "https://u:p@a.kr", "https://a.kr/x")] == [True] * 4 + [False]


@pytest.mark.parametrize(
    ("iso", "quote", "ok"),
    [("2025-03-09", "2025/3/8 - 2025/3/9", True), ("2025-03-09", "3월 9일까지", True), ("2025-03-09", "’25. 3. 9.", True), ("2025-03-09", "25.03.09 마감", True), ("2025-03-09", "2024. 3. 9.", False), ("2025-15-01", "15. 1.", False), (None, "3월 9일", False), ("2025-03-09", None, False)],
)
def test_dates(spark, iso, quote, ok):
    assert spark.createDataFrame([(iso, quote)], "i string, q string").select(facts.names_date(F.col("i"), F.col("q"))).first()[0] == ok


def test_contacts(spark):
    found = one(spark, "전화 02-123-4567, 010-1234-5678 010-1234-5678 a@b.kr 2026-08-14 123-45-67890", tx.contacts)
    assert (found["phones"], found["emails"]) == (["02-123-4567", "010-1234-5678"], ["a@b.kr"])
    assert one(spark, "담당자: 홍길동 / 김철수 주무관 a@b.kr", tx.mask_contacts) == "담당자: [담당자] / [담당자] 주무관 [이메일]"


def test_safe(spark):
    assert one(spark, "<b>[x](javascript:1)\x00", tx.publishable) == "＜b＞［x］(javascript：1)"
    df = spark.createDataFrame([(("<", "http://[::1]"), ["<"], {"k": ">"})], "a struct<t:string,url:string>, b array<string>, c map<string,string>")
    r = tx.publishable_record(df).first()
    assert (r.a.t, r.a.url, r.b, r.c) == ("＜", "http://[::1]", ["＜"], {"k": "＞"})


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "가나  다라\n마바 | 사아", "x")], "notice_id bigint, text string, quote string")
    ev = spark.createDataFrame([(1, 1, "s", "가나 다라 마바"), (2, 1, "s", "없는 문장이다"), (3, 1, "s", None), (4, 1, "s", "가나"), (1, 1, "s", "가나 다라 마바"), (5, 2, "s", "가나 다라"), (6, 1, "s", "ｶ가나다라마"), (7, 1, "s", "가나다라-마바")], "evidence_id bigint, notice_id bigint, section string, quote string")
    assert {r["evidence_id"]: r["found"] for r in checks.quotes_exist(ev, docs).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}


def test_budget_and_attachments(spark):
    docs = spark.createDataFrame([(1, i, 10 + i, "a" * n) for i, n in enumerate((15000, 9000, 4000, 100, 50))], "notice_id bigint, doc_ord int, src_doc_id bigint, text string")
    assert [r["n_chars"] for r in collection.prompt_budget(docs).orderBy("src_doc_id").collect()] == [14000, 9000, 3000, 0, 0]
    assert [r["outcome"] for r in collection.first_attachments(docs).orderBy("src_doc_id").collect()] == ["taken"] * 3 + ["not_tried"]


def test_html():
    page = """<html><head><title>A &amp; B</title></head><body><nav>menu</nav><div class="board_view"><table><tr><th>기간</th><td>5월</td><td></td></tr></table><dl><dt>문의</dt><dd>팀</dd></dl><p>본문</p>
    <a href="/f/a.pdf">공고문</a><a href="javascript:x">n</a><img src="poster.png"><img src="logo.png"></div><script>x</script></body></html>"""
    text, title, links, images = page_parts(page, "https://a.kr/b")
    assert text.split("\n")[:3] == ["기간 | 5월", "문의 | 팀", "본문"] and title == "A & B" and "menu" not in text and "x" not in text.split("\n")
    assert links == [{"url": "https://a.kr/f/a.pdf", "label": "공고문", "kind": "pdf"}] and images == ["https://a.kr/poster.png"]
    assert page_parts(None) == ("", None, [], []) and page_parts("")[0] == ""


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in files.items():
            z.writestr(n.replace("__", "/").replace("_DOT_", "."), d)
    return b.getvalue()


def test_containers():
    assert containers.docx_text(zipped(word__document_DOT_xml="<w:p><w:r><w:t>가</w:t></w:r><w:r><w:t xml:space='preserve'>나</w:t></w:r></w:p><w:p><w:t>다</w:t></w:p>")) == "가나\n다"
    assert containers.hwpx_text(zipped(Contents__section1_DOT_xml="<hp:p><hp:t>b</hp:t></hp:p>", Contents__section0_DOT_xml="<hp:p><hp:t>a</hp:t><hp:t>c</hp:t></hp:p>")) == "a c\nb"
    body = "가".encode("utf-16-le") + struct.pack("<8H", 2, 0, 0, 0, 0, 0, 0, 2) + "나".encode("utf-16-le")
    assert containers.hwp_section_text(struct.pack("<I", 67 | len(body) << 20) + body) == "가나"
    with pytest.raises(ValueError):
        containers.docx_text(zipped(**{f"f{i}": "" for i in range(600)}))
    assert containers.decoded("가나다라".encode("cp949")) == "가나다라" and containers.decoded("가".encode()) == "가"
    korean = "<meta charset=utf-8>" + "가나다라마바사아자차카타파하" * 9
    assert containers.decoded(korean.encode("cp949")) == korean and containers.decoded("한글".encode("cp949"), "euc-kr") == "한글"


def compound(streams):
    """A compound file of the given streams, each over the limit of small ones, one folder deep."""
    size, data, fat, entries = 512, [], [], []

    def add(raw):
        first, n = len(data), max(1, -(-len(raw) // size))
        data.extend(raw[k * size : (k + 1) * size].ljust(size, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    def entry(name, kind, left, right, child, start, length):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, length)

    none = 0xFFFFFFFF
    head, section = (streams[k].ljust(5000, b"\0") for k in ("FileHeader", "Section0"))
    entries = [entry("Root Entry", 5, none, none, 1, 0xFFFFFFFE, 0), entry("FileHeader", 2, none, 2, none, add(head), len(head)), entry("BodyText", 1, none, none, 3, 0, 0), entry("Section0", 2, none, none, none, add(section), len(section))]
    directory = add(b"".join(entries))
    table = len(data)
    fat.append(0xFFFFFFFD)
    data.append(struct.pack("<128I", *fat, *[none] * (128 - len(fat))))
    header = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", table, *[none] * 108)
    return header + b"".join(data)


def test_hwp_file():
    body = "공고문 본문".encode("utf-16-le")
    record = struct.pack("<I", 67 | len(body) << 20) + body
    deflate = lambda d: (z := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(d) + z.flush()
    head = lambda flags: b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, flags)
    assert containers.hwp_text(compound({"FileHeader": head(1), "Section0": deflate(record)})).strip("\0\n") == "공고문 본문"
    with pytest.raises(ValueError, match="encrypted"):
        containers.hwp_text(compound({"FileHeader": head(3), "Section0": deflate(record)}))
    with pytest.raises(ValueError, match="too large"):
        containers.hwp_text(compound({"FileHeader": head(1), "Section0": deflate(b"\0" * (containers.MAX_ENTRY + 1))}))


def test_file_names_and_replies(spark):
    latin = "공고.hwp".encode("euc-kr").decode("latin-1")
    rows = [(f'attachment; filename="{latin}"',), ("attachment; filename*=UTF-8''%EA%B0%80.pdf",), ("inline",), (None,)]
    got = [r["n"] for r in containers.with_file_name(spark.createDataFrame(rows, "h string"), "h", "n").collect()]
    assert got == ["공고.hwp", "가.pdf", None, None]
    assert containers.parsed_reply({"content": {"text": " 가 "}}) == "가" and containers.parsed_reply({"content": {"html": "<p>가<br>나</p>"}}) == "가\n나"
    assert containers.parsed_reply({"elements": [{"content": {"markdown": "가"}}, {"content": None}, {"content": {"html": "<b>나</b>"}}]}) == "가\n나" and containers.parsed_reply({}) == ""
    extra = {"image": lambda raw: containers.parsed_reply({"content": {"text": raw[4:].decode()}})}
    files = spark.createDataFrame([("p.png", 9, bytes.fromhex("89504E47") + b"text")], "path string, length bigint, content binary")
    assert containers.read_files(files, extra).first()["text"] == "text"


def test_lists_and_links(spark):
    rows = spark.createDataFrame([("https://a.example/1",), ("# x",), ("",), (None,)], "value string")
    assert [r["url"] for r in containers.url_list(rows).collect()] == ["https://a.example/1"]
    pages = spark.createDataFrame([("<loc> https://a.example/list/1 </loc><loc>https://a.example/b</loc>",), (None,)], "xml string")
    assert [r["url"] for r in containers.sitemap_urls(pages, "xml", "/list/").collect()] == ["https://a.example/list/1"]
    assert [r["url"] for r in containers.sitemap_urls(pages, "xml", "/", "/list/").collect()] == ["https://a.example/b"]
    assert containers.zip_text(zipped(word__document_DOT_xml="<w:p><w:t>가</w:t></w:p>")) == "가"
    with pytest.raises(ValueError, match="no section"):
        containers.zip_text(zipped(other=""))
    links = spark.createDataFrame([("k", "https://a/xx"), ("k", "https://a/?b"), ("k", "https://a/?a"), ("k", None)], "k string, url string")
    assert [tuple(r) for r in collection.best_link(links, "k").collect()] == [("k", "https://a/?a")]


def test_read_files(spark):
    rows = [("a.docx", 10, zipped(word__document_DOT_xml="<w:p><w:t>가</w:t></w:p>")), ("b.pdf", 10, b"%PDF-1"), ("c.txt", 3, "나".encode()), ("d", 1 << 30, b""), ("e.hwp", 9, bytes.fromhex("D0CF11E0A1B11AE1"))]
    got = {r.path: (r.text, r.skipped is None) for r in containers.read_files(spark.createDataFrame(rows, "path string, length bigint, content binary")).collect()}
    assert got["a.docx"] == ("가", True) and got["c.txt"] == ("나", True) and not any(got[p][1] for p in ("b.pdf", "d", "e.hwp"))


def test_runner(spark):
    tries = iter(["none", '{"a": "x"}', 'text {"a": 1} end'])
    assert complete_json(Replay(lambda p: next(tries)), "", "p", lambda r: [] if isinstance(r.get("a"), int) else ["a must be a number"]) == ({"a": 1}, None)
    df = spark.createDataFrame([(1, "p"), (2, None), (3, "q")], "id bigint, prompt string")
    got = {r.id: (r.reply, r.problem) for r in apply_runner(df, "id", "prompt", Replay({"p": '{"a": 1}', "": "{}"}), "", lambda r: []).collect()}
    assert got[1] == ('{"a": 1}', None) and got[2] == ("{}", None) and got[3][0] is None


def test_stream(spark, tmp_path):
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    (jobs / "1.json").write_text('{"job_id": 1, "url": "a", "requested_at": "2024-01-01T00:00:00"}\n{"job_id": 2, "url": "b", "requested_at": "2024-01-01T00:00:00"}\n')
    analyse = lambda d: d.select("job_id", F.when(F.col("job_id") == 1, "published").otherwise("queued").alias("state"))
    for _ in range(2):
        q = run_jobs(spark.readStream.schema(JOB).json(str(jobs)), analyse, str(tmp_path / "states"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        (jobs / "2.json").write_text('{"job_id": 1, "url": "a", "requested_at": "2024-01-01T00:00:00"}\n')
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "states")).collect()) == [(1, "published"), (2, "queued")]


def test_entry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
