import random
import unicodedata

import pytest
import regex

from noticeloom.llm import canonical, mixing, mojibake, pages, pii, scans, tokens, truncation

VOCABULARY = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}.tiktoken"


@pytest.mark.parametrize("text", ["2025년 환경 사업 · 신청자격 ※ 안내", "○ 쿠키·비스킷 제조업 9㎡"])
@pytest.mark.parametrize(("true", "seen", "times"), [("utf-8", "cp1252x", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252x", 2), ("cp949", "cp1252x", 1)])
def test_mojibake_round_trip(text, true, seen, times):
    bad = text
    for _ in range(times):
        bad = mojibake._latin(bad.encode(true), seen == "cp1252x")
    fixed, pairs, lines, lost = mojibake.repair_text(bad)
    assert (fixed, bool(pairs), lines, lost) == (text, True, 1, 0)


def test_mojibake_restores_originals():
    """Sentences garbled in each way must come back sign for sign."""
    rng = random.Random(8)
    words = "신청 기업은 사업계획서와 통장사본을 갖추어 온라인으로 제출해야 한다 지원금은 재료비에 쓸 수 있고 결과는 개별 안내한다".split()
    ways = {
        "utf-8 as cp1252": lambda t: mojibake._latin(t.encode(), True), "twice": lambda t: mojibake._latin(mojibake._latin(t.encode(), True).encode(), True),
        "cp949 as cp1252": lambda t: mojibake._latin(t.encode("cp949"), True), "utf-8 as cp949": lambda t: t.encode().decode("cp949"), "utf-8 as cp1251": lambda t: t.encode().decode("cp1251"), "cp949 as gbk": lambda t: t.encode("cp949").decode("gbk"),
    }
    for way, garble in ways.items():
        right = total = 0
        for _ in range(200):
            text = " ".join(rng.sample(words, 8))
            try:
                bad = garble(text)
            except UnicodeError:
                continue
            total += 1
            right += mojibake.repair_text(bad)[0] == text
        assert total == 0 or right >= 0.97 * total, (way, right, total)
    assert mojibake.repair_text("한국".encode("cp949").decode("shift_jis", "ignore"))[1] in ([], [mojibake.EUC_KANA])
    deep = "가나다라"
    for _ in range(mojibake.DEPTH + 1):
        deep = mojibake._latin(deep.encode(), False)
    assert mojibake.DEEPER in mojibake.repair_text(deep)[1]
    for text in ("Привет, это комната №5 и ещё кофе", "ｶﾌｪ ﾃﾗｽ"):
        assert mojibake.repair_text(text) == (text, [], 0, 0)


def test_mojibake_leaves_correct_text():
    for text in ("São Paulo Zürich Malmö Hà Nội Besançon Café Lumière", "中小企業 株式會社 カフェ", "±5°C · © 2024", None, "", "가" * 100_000):
        assert mojibake.repair_text(text) == (text, [], 0, 0)
    mixed = "전시 부스는 São Paulo\nâ—‹ 대학Â·연구기관"
    assert mojibake.repair_text(mixed)[0] == "전시 부스는 São Paulo\n○ 대학·연구기관"
    assert mojibake.repair_text("��� 안내")[3] == 1


def test_mojibake_utf8_as_cp949():
    bad = lambda text: text.encode().decode("cp949")
    for text in ("목록보기", "목록", "참여마당"):
        assert mojibake.repair_text(bad(text)) == (text, [mojibake.UTF8_EUC], 1, 0)
        # beside correct Hangul, also where the text went through a normal form
        assert mojibake.repair_text(f"정상 글의 {unicodedata.normalize('NFC', bad(text))}나 URL")[0] == f"정상 글의 {text}나 URL"
    fixed, pairs, lines, lost = mojibake.repair_text(f"\ufffd {bad('목록')} \ufffd")
    assert (fixed, lines, lost) == ("\ufffd 목록 \ufffd", 1, 1)
    for text in ("李씨와 洪씨", "大韓民國 李承晩 박사", "紐約 여행"):
        assert mojibake.repair_text(text) == (text, [], 0, 0)


def test_garbled_records(spark):
    src = spark.createDataFrame([(1, "Â·예비", "x"), (1, "Â·예비", "x"), (2, None, "x"), (3, "", "x"), (4, "정상", "x")], "src_doc_id bigint, text string, fixed string")
    pre = spark.createDataFrame([(1, "â—‹ 가")], "preset_id bigint, text string")
    assert sorted(map(tuple, mojibake.garbled_records(src, pre).collect())) == [("preset_documents", 1), ("source_documents", 1)]
    assert mojibake.repaired_records(src.limit(0), pre.limit(0)).collect() == []
    assert {r["fixed"] for r in mojibake.repaired_records(src, pre).collect()} >= {"·예비", "○ 가", "정상"}


def test_canonical():
    c = canonical.canonical
    assert c("ＥＳＧ 과​제 ΕЅG") == "ESG 과제 ESG"
    assert c("ᄒ­ᅣᆼ락") == "향락" and c("한ü") == "한ü"
    assert c("①② ㎡ ½ ⓒ") == "①② ㎡ ½ ⓒ" and c("О0") != c("00") and c("가\n나") != c("가 나")
    assert c(None) is None and c("") == ""
    assert c("ꓢꓳꓧꓳ ᎪᏴ ﬁn") == "SOHO AB fin" and c("각") == "각" and c("가\u11a8") == "각"
    for code in [*range(0x80, 0x3000), *range(0xA000, 0xA500), *range(0xF900, 0x10000)]:
        x = "가" + chr(code) + "a"
        assert x[1] not in canonical.unstable() or regex.search(canonical.COARSE, x[1]), hex(code)
        assert x[1] in canonical.unstable() or c(x) == x == unicodedata.normalize("NFC", x), hex(code)
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("가나 a1·ㆍ​ＡΑӒ한①～-－") for _ in range(12))
        assert c(c(t)) == c(t)


def test_lookalike_quotes(spark):
    docs = spark.createDataFrame([(1, "u", "가나 ESG 과제", "q"), (1, "v", None, "q")], "notice_id bigint, url string, text string, quote string")
    ev = spark.createDataFrame([(1, 1, "u", "가나 ΕЅG"), (2, 1, "u", "가나 ESG"), (3, 1, "u", "가나 ESC"), (4, 1, None, "ΕЅG"), (5, 1, "u", None), (1, 1, "u", "가나 ΕЅG"), (6, 1, "u", "")], "evidence_id bigint, notice_id bigint, source_url string, quote string")
    assert [r[0] for r in canonical.lookalike_quotes(ev, docs).collect()] == [1]
    assert canonical.lookalike_quotes(ev.limit(0), docs).collect() == []


def page(number, head, tail, banner="[배너] 상담 바로가기"):
    parts = [f"{k}. {x}" for k, x in enumerate(("사업 개요", "신청 자격", "제출 서류", "접수 방법", "심사 기준", "유의 사항"), 1)]
    lines = [*head, f"2024년 서울 게임 사업 모집 공고 {number}", f"해오름창업진흥원 공고 제2024-{1000 + number}호", ""]
    for k, part in enumerate(parts):
        lines += [part, *[f"{x} {part[3:]}: {number}개사 내외" for x in ("첫째", "둘째", "셋째")[number % 3 :][:1]], f"{'홀짝'[number % 2]} {part[3:]}에 관한 문장은 다른 공고와 같습니다."]
        lines += [banner, "2025년 부산 물류 사업 참가자 모집"] * (k == number % 6)
    return "\n".join([*lines, *tail])


def test_pages(spark):
    """Only html documents: two hosts, of which one has the other's closing line in its bodies."""
    schema = "src_doc_id bigint, url string, kind string, title string, text string, line string"
    rows = [(i, f"https://a.example/{i}", "html", None, page(i, ["메뉴", "로그인"], ["목록보기", f"오늘 방문 {i}"]), "x") for i in range(1, 41)]
    rows += [(100 + i, f"https://b.example/{i}", "html", None, page(i, ["처음으로"], ["목록보기는 따로 있습니다."] * (i % 3 == 0) + ["인쇄", f"주소 {i}"]), "x") for i in range(1, 41)]
    rows += [(300, "https://a.example/300", "html", None, None, "x"), (301, None, "html", None, "", "x"), (302, "https://a.example/302", "hwp", None, "메뉴", "x"), rows[0]]
    df = spark.createDataFrame(rows, schema)
    out = {}
    for d, n in map(tuple, pages.surroundings(pages.split_pages(df)).collect()):
        out.setdefault(d, []).append(n)
    whole = {r[0]: r[4].split("\n") for r in rows if r[4]}
    for d, lines in whole.items():
        if d < 300:
            want = [i for i, x in enumerate(lines) if x.startswith(("메뉴", "로그인", "처음으로", "[배너]", "2025년")) or x in ("목록보기", "인쇄") or x.startswith(("오늘 방문", "주소"))]
            assert sorted(out[d]) == want, d
    assert set(out) == {d for d in whole if d < 300}
    got = pages.bodies(pages.split_pages(df, with_text=True)).where("src_doc_id = 1").first()["text"].split("\n")
    assert got[0] == "2024년 서울 게임 사업 모집 공고 1" and got[-1] == "짝 유의 사항에 관한 문장은 다른 공고와 같습니다."
    assert pages.surroundings(pages.split_pages(df.limit(0))).collect() == []


def test_pages_without_number_line():
    cut = pages.cut_page("메뉴\n2024년 사업 공고\n1. 개요\n본문\n2. 끝\n인쇄", "2024년　사업 공고")
    assert cut[0] == [0, 1, 2, 3, 4, 5]
    assert [b & 15 for b in cut[-1]] == [pages.BEFORE, pages.TITLE, pages.ENCLOSED, pages.ENCLOSED, pages.ENCLOSED, pages.CLOSING]
    assert [b & 15 for b in pages.cut_page("메뉴\n1. 개요\n본문\n2. 끝\n인쇄", None)[-1]] == [pages.ENCLOSED] * 4 + [pages.CLOSING]


def test_pii():
    text = "담당자 : 이다담 / 전화 033) 055-8599 / 이메일 noori @ a.example\n주소 가람시 햇살마당로 313-27 / 대표전화 +82 (0)2 125 2169\n선정기업 대표자 한가결 (주민등록번호 741108-1016704)\n관리번호 2026175728120\n휴대전화 010-****-4601\n사업자등록번호 361-77-44983\n담당 주무관 확인 후 담당자가 접수\n서울특별시 소재 기업"
    got = [(text[p : p + n], k) for p, n, k in pii.mentions(text)]
    assert got == [("이다담", "name"), ("033) 055-8599", "phone"), ("noori @ a.example", "email"), ("가람시 햇살마당로 313-27", "address"), ("+82 (0)2 125 2169", "phone"), ("한가결", "name"), ("741108-1016704", "id_number")]
    hidden = "☎ ０１０－​０１４８－１９４６"
    assert [(hidden[p : p + n], k) for p, n, k in pii.mentions(hidden)] == [("０１０－​０１４８－１９４６", "phone")]
    assert pii.mentions("") == [] and pii.mentions("가나다 " * 30_000) == []


def test_pii_person_lists():
    def names(text):
        return [text[p : p + n] for p, n, k in pii.mentions(text) if k == "name"]

    assert names("평가위원 명단: 조온울, 한가솔 교수, 남궁해결(가람대), 홍OO 외 2명") == ["조온울", "한가솔", "남궁해결"]
    assert names("참석자 명단（2024）：서해온，\n정초랑\n선정자 명단: 공고문 참조, 이의신청") == ["서해온", "정초랑"]
    assert names("명단: 김도봄" + ", 김도봄" * 999) == ["김도봄"] * 1000
    assert names("심사위원: 송늘슬, 정가담, 황라담 위원") == ["송늘슬", "정가담", "황라담"]
    for cue in pii.CUES:
        assert names(f"{cue}: 한가결 (가람시)") == ["한가결"], cue
    assert names("담당자: 한가결, 이메일, 전화") == ["한가결"] and names("제출 명단: 신청서, 이력서") == [] and names("대표 이메일(a@b.example)") == []


def test_pii_recall_by_type():
    """Planted mentions of each type between other text; every one must come out whole."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    day = lambda: f"{rng.randint(50, 99)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}"
    name = lambda: rng.choice("김이박최정한황서") + rng.choice("가나다하도") + rng.choice("온람솔늘해")
    make = {
        "email": lambda: rng.choice((f"ab{digits(3)}@mail.example", f"kim.{digits(2)} @ a-b.example", f"x{digits(2)}[at]c.example")),
        "phone": lambda: rng.choice((f"010-{digits(4)}-{digits(4)}", f"02) {digits(3)}-{digits(4)}", f"+82 (0)31 {digits(3)} {digits(4)}", f"(033) {digits(3)}-{digits(4)}", f"1588-{digits(4)}")),
        "id_number": lambda: rng.choice((f"{day()}-1{digits(6)}", f"{day()} - 2{digits(6)}", f"{day()}3{digits(6)}", f"M{digits(8)}", f"11-{digits(2)}-{digits(6)}-{digits(2)}")),
        "address": lambda: rng.choice((f"가람시 은하대로 {rng.randint(1, 99)}-{rng.randint(1, 9)}", f"서울특별시 마루구 별빛나루로 {rng.randint(1, 99)}, 이음관 3층", f"강원도 한울군 미르면 새솔동 산 {rng.randint(1, 99)}번지", f"{rng.randint(1, 99)} Saessak-gil, Hanul-gun")),
        "name": lambda: f"{name()}",
    }
    frame = {"email": "이메일 {} 로", "phone": "전화 {} 입니다", "id_number": "번호 {} 확인", "address": "주소: {} 에서", "name": "담당자: {} (팀)"}
    for kind, one in make.items():
        for _ in range(200):
            x = one()
            text = "사업 안내 2024. 3. 5. 접수\n" + frame[kind].format(x) + "\n관리번호 2026175728120, 사업자등록번호 361-77-44983"
            assert [(text[p : p + n], k) for p, n, k in pii.mentions(text)] == [(x, kind)], text


def test_pii_latin_names_and_cues():
    for text, want in (("작성자 John Smith", "John Smith"), ("담당자: Jane Roe (팀)", "Jane Roe"), ("주민등록번호: 7411081016704", "7411081016704")):
        assert [text[p : p + n] for p, n, _ in pii.mentions(text)] == [want]


def test_pii_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.kr 그리고 010-1234-5678 끝", "x"), (2, None, "x"), (3, "", "x")], "src_doc_id bigint, text string, mentions string").drop("mentions")
    contacts = spark.createDataFrame([(1, ["010-1234-5678", None, "내선 450", "a@b.kr"], None), (1, ["010-1234-5678", None, "내선 450", "a@b.kr"], None), (2, [], [""])], "contact_id bigint, phones array<string>, emails array<string>")
    got = sorted(map(tuple, pii.pii_mentions(docs, contacts).collect()))
    assert got == [("contacts.phones", 1, 0, "phone"), ("contacts.phones", 1, 3, "email"), ("source_documents", 1, 0, "email"), ("source_documents", 1, 11, "phone")]
    assert {r["src_doc_id"]: r["masked"] for r in pii.masked_documents(docs).collect()} == {1: "[EMAIL] 그리고 [PHONE] 끝", 3: ""}


def test_scans(spark):
    head = "2024년 서울 게임 사업 참여기업 모집 공고"
    scan = f"{head}\n{head}\n공고 제2024-1호\n신청서는 온라인으로 제출합니\n다. 서류를 갖추어 제출한-\nPage 1\n2O24년 서울 게임 사업 참여기업 모집 공고\n다. 기업올 모집한다"
    clean = f"{head}\n공고 제2024-1호\n" + "신청서는 온라인으로 제출합니다. 서류를 갖추어 제출한다. 기업을 모집한다"
    rows = [(1, "image", scan, "x"), (1, "image", scan, "x"), (2, "image", None, "x"), (3, "pdf", "", "x"), *[(10 + i, "text", clean, "x") for i in range(4)]]
    df = spark.createDataFrame(rows, "src_doc_id bigint, kind string, text string, m string")
    got = sorted((r["line_no"], r["noise_kind"]) for r in scans.page_noise(df).collect())
    assert got == [(0, "header"), (3, "split_word"), (4, "split_word"), (5, "page_no"), (6, "header"), (7, "misread")]
    assert "제출합니다" in scans.repaired_text(df).first()["text"]
    assert scans.page_noise(df.limit(0)).collect() == []


def scan_of(lines, rng, header):
    """What scanning makes of lines: pages of 9 lines with header and number, broken words, misread signs; and where."""
    out, noisy, page = [header], {(0, "header")}, 3
    for k, line in enumerate(lines):
        words = line.split(" ")
        for n, w in enumerate(words[:-1]):
            for a, b in (("을", "올"), ("에서", "에셔"), ("신청", "신쳥"), ("제출", "졔츌"), ("원", "윈")):
                if a in w and rng.random() < 0.3:
                    words[n] = w.replace(a, b)
                    noisy.add((len(out), "misread"))
                    break
        if len(words[-1]) > 3 and k + 1 < len(lines) and rng.random() < 0.3:
            cut = len(words[-1]) // 2
            noisy.add((len(out), "split_word"))
            out += [" ".join([*words[:-1], words[-1][:cut] + "-"])]
            out += [words[-1][cut:]]
        else:
            out.append(" ".join(words))
        if k % 9 == 8:
            noisy |= {(len(out), "page_no"), (len(out) + 1, "header")}
            out += [f"- {page} -", header]
            page += 1
    return out, noisy


def test_scans_round_trip(spark):
    rng = random.Random(11)
    words = "기업은 신청서를 기한 안에서 온라인으로 제출하고 담당자는 자격을 확인한 뒤에 지원금을 지급하며 협약을 맺은 사업장에서 교육을 이수한다".split()
    sentence = lambda: " ".join(rng.sample(words, 8)) + " 안내한다."
    table = ["12", "[1]", "I", "구분 | 한도"]
    docs, want, planted = [], {}, {}
    for d in range(40):
        clean = [sentence() for _ in range(30)]
        clean[20:20] = table
        scan, noise = scan_of(clean, rng, f"제{d}차 지원사업 참여기업 모집 공고문")
        docs += [(d, "image", "\n".join(scan)), (1000 + d, "text", "\n".join(x for x in clean if x not in table))]
        want[d], planted[d] = "".join("".join(clean).split()), noise
    df = spark.createDataFrame(docs, "src_doc_id bigint, kind string, text string")
    found = {d: set() for d in want}
    for r in scans.page_noise(df).collect():
        found[r["src_doc_id"]].add((r["line_no"], r["noise_kind"]))
    hit, n, got = (sum(len(f(d)) for d in want) for f in (lambda d: found[d] & planted[d], planted.get, found.get))
    extra = sorted((d, x, docs[2 * d][2].split("\n")[x[0]]) for d in want for x in found[d] - planted[d])
    assert hit >= 0.97 * n and hit >= 0.97 * got, extra[:9]
    back = {r["src_doc_id"]: "".join(r["text"].split()) for r in scans.repaired_text(df).collect()}
    assert sum(back[d] == want[d] for d in want) >= 36, next((back[d], want[d]) for d in want if back[d] != want[d])


def test_scans_numbers_that_are_no_pages():
    roles = scans.line_roles(["가나다라 사업", "본문", "12", "본문이 이어진다", "[1]", "3 / 5", "I", "OO", "끝"])
    assert roles == ["body"] * 9
    pages = ["사업의 목적", "1", "신청하는 방법", "2", "그 밖에 알릴 것", "3"]
    assert scans.line_roles(pages) == ["body", "page_no"] * 3
    footers = [x for k in range(1, 5) for x in (f"본문 {k}{'가나다라'[k - 1] * 5}", "누리재단 안내서", f"- {k} -")]
    assert scans.line_roles(footers) == ["body", "header", "page_no"] * 4


def test_scans_vowels_and_letters(spark):
    clean = "지원금은 현금과 지방세를 R&D 중소벤처 수수료 확인\n그 츠금은 좋은 사업이다"
    # 쇼쇼료 has ㅗ for ㅜ, which isn't confused; 초굼운 has ㅗ and ㅜ for the ㅡ of 츠금은
    lines = ["가나", "가 지윈귬은 나", "가 현귬과 나", "가 지방세룰 나", "가 K&D 나", "가 중소벤처 나", "가 쇼쇼료 나", "가 초굼운 나", "나 지방세룰", "현귬과 나"]
    rows = [(1, "image", "\n".join(lines)), *[(10 + i, "text", clean) for i in range(4)]]
    df = spark.createDataFrame(rows, "src_doc_id bigint, kind string, text string")
    got = sorted(r["line_no"] for r in scans.page_noise(df).collect() if r["noise_kind"] == "misread")
    assert got == [1, 2, 3, 4, 7, 8, 9]


def test_vocabulary_of_a_very_long_line(spark):
    df = spark.createDataFrame([("가 " * 1_000_001 + "나 다",)], "text string")
    got = {(r["m"], r["m2"]): r["n"] for r in scans.vocabulary(df).collect()}
    assert got == {("가", "가"): 1_000_000, ("가", "나"): 1, ("나", "다"): 1, ("다", None): 1}


def test_tokens_match_reference_library():
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=tokens.PRETOKEN, mergeable_ranks=tokens.read_ranks(VOCABULARY), special_tokens={})
    e = tokens.Encoder(VOCABULARY)
    rng = random.Random(2)
    texts = ["", "<|endoftext|> a\x00b", "  \n\n \t x", "é̀ 😀😀 가나다", "I'll don't 1234 ⁇unknown ▁ <unk>", "가" * 3000] + ["".join(rng.choice("가나 abc\n\t12😀é.,'s") for _ in range(80)) for _ in range(60)]
    assert e.encode_batch(texts) == [other.encode_ordinary(t) for t in texts]
    assert [e.decode(x) for x in e.encode_batch(texts)] == texts and e.encode_batch([None]) == [[]]


def test_flow_meets_shares():
    targets = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 3)}
    total, sent = mixing.plan_flow({("a",): 100.0, ("b",): 90.0, ("c",): 10.0, ("a", "c"): 5.0}, targets)
    assert total == pytest.approx(225, rel=1e-4)  # c can have 10 and 5 texts three times
    for s, (share, _) in targets.items():
        assert sum(x for (_, t), x in sent.items() if t == s) == pytest.approx(share * total, rel=1e-4)
    assert mixing.plan_flow({}, targets) == (0.0, {})


def test_mixing(spark):
    rows = [(i, "abc"[i % 3], f"text number {i} " * 20, "x") for i in range(300)] + [(1000, "a", None, "x"), (1001, None, "t", "x"), (1002, "a", "", "x"), (0, "a", "text number 0 " * 20, "x"), (2000, "b", "text number 0 " * 20, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens string").drop("n_tokens")
    goals = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 2), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, goals)
    got = {r["source"]: r for r in mixing.shares(mix, goals).collect()}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 and r["most_uses"] <= r["max_repeats"] for r in got.values())
    copies = spark.createDataFrame([(i, "a", "same text " * 9) for i in range(10)], "doc_id bigint, source string, text string")
    all_a = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert [mixing.mixed(copies, all_a, merge_copies=m).count() for m in (True, False)] == [1, 10]
    assert mixing.mixed(docs.limit(0), goals).collect() == [] and sorted(map(tuple, mixing.mixed(docs, goals).collect())) == sorted(map(tuple, mix.collect()))


def test_truncation(spark):
    whole = ["신청서의 사업 기간은 6개월을 넘지 않도록 작성한다. 제출한 서류는 반환하지 않는다.", "신청 자격\n- 통장사본 3부\n- 사업계획서 2부\n안내를 마친다.", "문의는 게시판을 이용한다.\n- 통장사본 3부", "제출한 서류는 반환하지 않는다.\n감사합니다", "안내를 마친다.\nhttps://a.kr/notice/1"]
    cut = ["안내를 마친다. 신청서의 사업 기간은 6개월을 넘", "안내를 마친다. 제출한 서류는", "안내를 마친다.\n- 사업계", "안내를 마친다. 제출한 서...", "안내를 마친다. 제출한 �"]
    rows = [(i, "s", t, "x") for i, t in enumerate(whole)] + [(100 + i, "s", t, "x") for i, t in enumerate(cut)] + [(200, "s", None, "x"), (201, None, " \n", "x"), (100, "s", cut[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, cut string")
    assert sorted(r["doc_id"] for r in truncation.truncated(df).where("cut").collect()) == [100, 101, 102, 103, 104]
    assert truncation.truncated(df.limit(0)).collect() == []
    # a field of 60 signs: texts cut there, and whole ones that happen to be as long
    rng = random.Random(3)
    words = [a + b + c for a in "가나다라마" for b in "바사아자차" for c in "카타파하갸"]
    long = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    fields = [(i, "f", x[:60].rstrip() + "겨" * (60 - len(x[:60].rstrip()))) for i, x in enumerate(long[:40])]
    fields += [(100 + i, "f", (x[:49] + ".\n문서번호 " + str(rng.randint(10**4, 10**5 - 1)))[:60]) for i, x in enumerate(long[40:])]
    fields += [(200 + i, "f", " ".join(rng.choice(words) for _ in range(10 + i % 17)) + ".") for i in range(300)]
    got = truncation.truncated(spark.createDataFrame(fields, "doc_id bigint, source string, text string")).where("cut").collect()
    assert {r["doc_id"] for r in got} == set(range(40)) and {r["signal"] for r in got} == {"limit"}
    spiked = spark.createDataFrame([(i, "s", "가" * (50 if i < 40 else 20 + i)) for i in range(120)], "doc_id bigint, source string, text string")
    assert [(r["length"]) for r in truncation.spikes(spiked).where("unit = 'chars'").collect()] == [50]
