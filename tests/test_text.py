"""Known answers for text functions."""

from tidemark.functions import anonymize as an
from tidemark.functions import labels as lb
from tidemark.functions import lexicon as lex
from tidemark.functions import normalize as nz
from tidemark.functions import parse as ps
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from pyspark.sql import functions as F


def test_squash(value):
    assert value(tx.squash, ["  A\n\nB   C ", None, " x y\x1c"]) == ["A B C", "", "x y"]


def test_parse_count(value):
    given = ["1.2K", "12 binh luan", "12 comments", "1,5 trieu", "3 ngan", "x", "", None, "2m"]
    assert value(ps.parse_count, given) == [1200, 12, 12, 1500000, 3000, None, None, None, 2000000]


def test_parse_digits_and_time(value):
    assert value(ps.parse_digits, ["1,2K", "a", None]) == [12, None, None]
    got = value(ps.parse_timestamp, ["2024-01-02 03:04:05.9", "2024-01-02T03:04:05Z", " 2024-01-02", "02/01/2024", ""])
    assert [str(g) for g in got] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", "None", "None"]


def test_hash_counts_null_as_empty(spark):
    import hashlib

    row = spark.range(1).select(
        ps.content_hash(F.lit("a"), F.lit(None).cast("string"), F.lit(1)).alias("h"),
        ps.content_hash(F.lit("a"), F.lit(1)).alias("g")).first()
    assert row["h"] == hashlib.sha256(b"a||1").hexdigest()
    assert row["g"] == hashlib.sha256(b"a|1").hexdigest()


def test_lengthened(value):
    given = ["buồnnnnn", "VUIIII", "!!!!!", "hahahaha", "hehehehe", "hihihihi", "huhuhuu"]
    assert value(tx.shorten_lengthened, given) == ["buồnn", "VUII", "!", "haha", "hehe", "hihi", "huhuu"]


def test_abbreviations_follow_list_order(value):
    given = ["K đc r bn ơi", "ng ta đi ik", "kok k", "ntn?", "k k k k"]
    assert value(tx.expand_safe_abbreviations, given) == [
        "không được rồi bạn", "người ta đi đi", "kok không", "như thế nào?", "không không không không"]


def test_independent_runs_keep_all_entries():
    runs = rx.independent_runs(lex.SAFE_ABBREVIATIONS)
    assert [p for r in runs for p in r.items()] == lex.SAFE_ABBREVIATIONS
    assert rx.independent_runs([("a", "b"), ("b", "c")]) == [{"a": "b"}, {"b": "c"}]


def test_cleaning_chain(value):
    given = ["Like · Reply 5 phút #Cfs1_DNTU Nguyễn Văn Nam và Lê Thị Hoa 😍\n\n\n\n gọi 0912345678\tnhé",
             "Xem thêm tất cả"]
    assert value(tx.clean_post, given) == ["[TÊN] và [TÊN] yêu_thích \n\n gọi  nhé", ""]


def test_validity_order(value):
    given = ["abc", "!" * 28 + "a", "[TÊN] " * 4 + "ab", "123456789 123456789 123", "đủ dài và hợp lệ nhé các bạn"]
    got = value(lambda c: tx.validity(c), given)
    assert [g["reason"] for g in got] == [
        "quá ngắn (3 ký tự)", "quá nhiều ký tự đặc biệt (28/29)", lex.REASON_ONLY_TAG, lex.REASON_DIGITS, lex.REASON_OK]
    assert [g["is_valid"] for g in got] == [False] * 4 + [True]


def test_content_lines(value):
    text = "DNTU - Confession\n4 tháng 11\n12\n Nội dung \nLike\nViết bình luận công khai\n\nhết"
    assert value(tx.content_lines, [text]) == ["Nội dung\nhết"]


def test_anonymize(value):
    given = ["Các bạn có biết thầy Lê Nhật Tùng không?", "tui không biết cô nguyễn thị liệu",
             "sinh viên phạm thế an là ai?", "thông báo về vi phạm nguyên tắc cộng đồng",
             "Nguyễn Tuấn Kiệt trường", "@[100:0:Nguyễn Văn A] https://www.facebook.com/a.b hi", "cô lê là ai", None]
    assert value(an.anonymize, given) == [
        "Các bạn có biết thầy [NAME] không?", "tui không biết cô [NAME]", "sinh viên [NAME] là ai?",
        "thông báo về vi phạm nguyên tắc cộng đồng", "[NAME] trường", "[NAME] [NAME] hi", "cô lê là ai", None]


def test_titles_inside_masked_names(value):
    given = ["Dem Dem Dem Dem Dem Dem Dem Dem ersch", "anh Nam Anh Tuan Le Van", "cô nguyễn thị em lê văn an", 'thầy "lê văn an" ở', "cô nguyễn và bạn", None]
    assert value(an.mask_titled_names, given) == [
        "Dem [NAME] Dem [NAME] ersch", "anh [NAME] Van", "cô [NAME] lê văn an", 'thầy [NAME]" ở', "cô nguyễn và bạn", None]
    assert value(lambda c: an.anonymize(c, in_order=True), given[:2]) == ["Dem [NAME] Dem [NAME] ersch", "anh [NAME] Van"]
    assert value(an.anonymize, given[:2]) == ["Dem [NAME] ersch", "anh [NAME]"]


def test_span_merge(value):
    spans = lambda *s: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s])
    text = ["Hùng Minh môn hay"]
    assert value(lambda c: an.replace_spans(c, spans((5, 9), (0, 4))), text) == ["[NAME] môn hay"]
    assert value(lambda c: an.replace_spans(c, spans((5, 9), (0, 4)), bridge_gaps=False), text) == ["[NAME] [NAME] môn hay"]
    assert value(lambda c: an.replace_spans(c, spans((0, 7), (3, 5), (6, 9))), text) == ["[NAME] môn hay"]
    assert value(lambda c: an.replace_spans(c, an.honorific_spans(F.lit("x"))), text) == text


def test_tagged_tokens(spark):
    tokens = [("Hùng", "B-PER"), ("Minh môn", "O"), ("hay", "O"), ("thầy", "O"), ("Lê Tùng khen", "B-LOC"),
              ("cô", "O"), ("phạm", "O"), ("thế an", "O"), ("là", "O")]
    text = "Hùng Minh môn hay thầy Lê Tùng khen cô phạm thế an là"
    df = spark.createDataFrame([(text, tokens)], "text string, tokens array<struct<token:string,tag:string>>")
    row = df.select(
        an.anonymize_tokens(F.col("text"), F.col("tokens")).alias("wide"),
        an.anonymize_tokens(F.col("text"), F.col("tokens"), extend=False).alias("narrow")).first()
    assert row["wide"] == "[NAME] môn hay thầy [NAME] khen cô [NAME] là"
    assert row["narrow"] == "[NAME] Minh môn hay thầy [NAME] khen cô [NAME] là"


def test_preprocess(value):
    given = ["#Cfs2295_DNTU Nhaaa k vui 😍 100k!!! https://abc.com", "#24399: mng đi 3 bước nhaaa :)))",
             "#thấygớm quá tr ơi 😡", "a_b <3 ✔ <i>x</i>", None, "ｋ ﬁn Ｔ"]
    got = value(lambda c: nz.preprocess(c, {"k": "không", "mng": "mọi người"}), given)
    assert got == [
        "nha không vui <smiling_face_with_heart_eyes> 100k <exclamation>",
        "mọi người đi ba bước nha <smile_emoticon>", "thấygớm quá tr ơi <enraged_face>",
        "a b <heart_emoticon> <check_mark> i x i", "", "không fin t"]


def test_number_words(value):
    cases = {"0": "không", "5": "năm", "10": "mười", "15": "mười lăm", "21": "hai mươi mốt", "24": "hai mươi bốn",
             "25": "hai mươi lăm", "100": "một trăm", "105": "một trăm lẻ năm", "110": "một trăm mười",
             "1000": "một nghìn", "2005": "hai nghìn không trăm lẻ năm", "12034": "mười hai nghìn không trăm ba mươi bốn",
             "100000": "một trăm nghìn", "999999": "chín trăm chín mươi chín nghìn chín trăm chín mươi chín",
             "007": "không không bảy", "1234567": "một hai ba bốn năm sáu bảy"}
    assert value(nz.read_number, list(cases)) == list(cases.values())


def test_number_contexts(value):
    cases = {"100k": " 100k ", "50 %": "năm mươi phần trăm", "7h30": "bảy giờ ba mươi", "1m65": "một mét sáu mươi lăm",
             "5m": "năm m", "2tr": "hai triệu", "15đ": "mười lăm đồng", "3abc": "ba abc", "a15": "a mười lăm",
             "b2b3": "b hai b ba", "12.50": "mười hai phẩy năm không", "1m65,5": "một mét sáu mươi lăm,năm", "x": "x"}
    assert value(nz.numbers_to_words, list(cases)) == list(cases.values())


def test_mojibake_and_accents(value):
    good = ["tiếng Việt có dấu", "chào", "plain"]
    bad = [g.encode("utf-8").decode("latin1") for g in good]
    assert value(nz.repair_mojibake, bad + ["Ã", "Ã……"]) == good + ["Ã", "Ã……"]
    assert value(nz.strip_accents, ["Đặng đỗ ỆỄ ñ"]) == ["Đang đo EE n"]


def test_labels(value):
    assert value(lb.class_word, ["LABEL_2", "neg", "odd", None]) == ["positive", "negative", "odd", None]
    assert value(lb.class_code, [" 1.0 ", "Neutral", "odd", None]) == ["1", "1", "odd", ""]
    assert value(lb.vote_code, ["Tich_Cuc", "2", "x", "", None]) == [2, 2, None, None, None]
    assert value(lb.sentiment_code, ["x", None, "negative"]) == [1, 1, 0]
    assert value(lb.answer_label, ["so LABEL_1", "It is POS", "none"]) == ["LABEL_1", "LABEL_2", None]


def test_strict_label_is_an_error(value):
    import pytest

    with pytest.raises(Exception, match="Invalid label"):
        value(lb.strict_code, ["maybe"])
    with pytest.raises(ValueError):
        lb.check_foreign_classes({0: "joy"})


def test_names_behind_marks_are_masked(value):
    got = value(lambda c: an.replace_spans(c, an.honorific_spans(c)), [
        "cô: nguyễn thị liệu", 'cô "nguyễn thị liệu"', "cô nguyễn và bạn", "cô nguyễn thị và bạn", "thầy 12 lê văn an ở"])
    assert got == ["cô[NAME]", 'cô [NAME]"', "cô nguyễn và bạn", "cô [NAME] và bạn", "thầy [NAME] ở"]


def test_angles_unwrap_at_any_depth(value):
    deep = "<" * 9 + " a b " + ">" * 9
    got = value(nz.unwrap_angles, [deep, "<ok_tag> < 1 < 2 > >", "<", "a < b"])
    assert "<" not in got[0] and got[0].split() == ["a", "b"] and got[1].split() == ["<ok_tag>", "1", "2"] and got[2:] == ["<", "a < b"]


def test_texts_are_taken_in_slices():
    import pyarrow as pa
    from tidemark.functions.batches import SLICE, map_texts, slices

    texts = ["ｋ" * 5, None, "", "x" * (3 * SLICE), "é"] + ["y" * 1000] * 3000
    column = pa.array(["cut", *texts]).slice(1)
    bounds = list(slices(column))
    assert [b for _, b in bounds[:-1]] == [a for a, _ in bounds[1:]] and (bounds[0][0], bounds[-1][1]) == (0, len(texts))
    assert all(b - a == 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= SLICE for a, b in bounds)
    assert map_texts(column, str.upper).to_pylist() == [None if t is None else t.upper() for t in texts]
    assert map_texts(pa.array([], pa.string()), str.upper).to_pylist() == []


def test_cleaning_steps_pass_over_texts_without_their_characters(value):
    texts = ["ab", "ab\n😍\nx", "a  b\t\tc\n\n\n\nd", "gọi 0912345678 +84912345678", "", None]
    assert value(tx.emoji_to_words, texts) == ["ab", "ab\n yêu_thích \nx", *texts[2:]]
    assert value(tx.tidy_layout, texts[2:]) == ["a b  c\n\nd", texts[3], "", None]
    assert value(tx.drop_phone_numbers, texts[2:]) == [texts[2], "gọi    ", "", None]
