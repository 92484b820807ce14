"""Word lists, tables, patterns and formats.

Everything here is data that results depend on; none of it is logic. Large
dictionaries (abbreviations, noise hashtags) are inputs, read with
``tidemark.sources.dictionaries``.
"""

from __future__ import annotations

# --- fixed values: sentiment classes -------------------------------------
LABEL_NAMES = {0: "negative", 1: "neutral", 2: "positive"}
LABEL_NAMES_VI = {0: "tieu_cuc", 1: "trung_lap", 2: "tich_cuc"}
RAW_LABELS = ["LABEL_0", "LABEL_1", "LABEL_2"]
EMOTION_RULES = """
2, Positive, [Enjoyment, Hope, Trust]
1, Neutral, [Other, Surprise]
0, Negative, [Fear, Sadness, Anger, Disgust]
"""

# --- fixed values: names of the classes a label column may use ------------
CLASS_WORDS = {
    "LABEL_0": "negative", "NEG": "negative", "NEGATIVE": "negative",
    "LABEL_1": "neutral", "NEU": "neutral", "NEUTRAL": "neutral",
    "LABEL_2": "positive", "POS": "positive", "POSITIVE": "positive",
}
CLASS_CODES = {
    "0": "0", "0.0": "0", "LABEL_0": "0", "NEG": "0", "NEGATIVE": "0",
    "1": "1", "1.0": "1", "LABEL_1": "1", "NEU": "1", "NEUTRAL": "1",
    "2": "2", "2.0": "2", "LABEL_2": "2", "POS": "2", "POSITIVE": "2",
}
TRAINING_ALIASES = {
    "0": 0, "0.0": 0, "negative": 0, "neg": 0, "label_0": 0, "tieu_cuc": 0, "tieu cuc": 0,
    "1": 1, "1.0": 1, "neutral": 1, "neu": 1, "label_1": 1, "trung_lap": 1, "trung lap": 1,
    "2": 2, "2.0": 2, "positive": 2, "pos": 2, "label_2": 2, "tich_cuc": 2, "tich cuc": 2,
}
FOREIGN_CLASS_NAMES = {
    "positive": 2, "pos": 2, "tích cực": 2, "tich cuc": 2,
    "negative": 0, "neg": 0, "tiêu cực": 0, "tieu cuc": 0,
    "neutral": 1, "neu": 1, "trung lập": 1, "trung lap": 1,
}
VOTE_ALIASES = {
    "negative": 0, "neutral": 1, "positive": 2,
    "tieu_cuc": 0, "trung_lap": 1, "tich_cuc": 2,
    "0": 0, "1": 1, "2": 2,
}
VOTE_PRIORITY = ["gemini", "phobert", "simcse", "bgem3"]
FINISHED_STATUS = ["done", "skipped"]
REPAIRABLE_STATUS = ["", "pending", "processing", "error"]

# --- fixed values: interface text patterns (kind, pattern) ------------------
UI_PATTERNS = [
    ("ui_text", r"Like\s*·?\s*Reply"),
    ("ui_text", r"Thích\s*·?\s*Trả lời"),
    ("timestamp", r"\d+\s*tuần"),
    ("timestamp", r"\d+\s*tháng"),
    ("timestamp", r"\d+\s*ngày"),
    ("timestamp", r"\d+\s*giờ"),
    ("timestamp", r"\d+\s*phút"),
    ("timestamp", r"\d+\s*giây"),
    ("ui_text", r"Xem thêm bình luận.*"),
    ("ui_text", r"Xem thêm.*"),
    ("ui_text", r"See more.*"),
    ("ui_text", r"Ẩn bớt.*"),
    ("ui_text", r"Phù hợp nhất.*"),
    ("page_name", r"DNTU\s*-\s*Confession"),
    ("ui_text", r"Bình luận dưới tên.*"),
    ("ui_text", r"Chia sẻ"),
    ("reaction_count", r"\d+\s*·\s*\d+"),
    ("reaction_count", r"\d+\s*lượt thích"),
    ("reaction_count", r"\d+\s*bình luận"),
    ("reaction_count", r"\d+\s*lượt chia sẻ"),
    ("ui_text", r"Trả lời"),
    ("ui_text", r"Chỉnh sửa"),
    ("hashtag_confession", r"#[Cc]fs\d+_[Dd][Nn][Tt][Uu]"),
    ("hashtag_confession", r"#[Cc][Ff][Ss]\d+_[Dd][Nn][Tt][Uu]"),
    ("url", r"http[s]?://\S+"),
    ("url", r"www\.\S+"),
    ("phone_number", r"0[3|5|7|8|9][0-9]{8}"),
    ("phone_number", r"\+84[0-9]{9}"),
]
# A word that every interface pattern needs, to pass over texts without any.
UI_WORDS = [
    "Reply", "Trả lời", "tuần", "tháng", "ngày", "giờ", "phút", "giây", "Xem thêm", "See more", "Ẩn bớt",
    "Phù hợp nhất", "DNTU", "Bình luận dưới tên", "Chia sẻ", "·", "lượt thích", "bình luận", "Chỉnh sửa",
]
UI_KINDS = ["ui_text", "timestamp", "reaction_count", "page_name"]

# --- fixed values: validity thresholds and reasons --------------------------
MIN_LENGTH = 20
MAX_SPECIAL_RATIO = 0.5
REASON_SHORT = "quá ngắn ({n} ký tự)"
REASON_SPECIAL = "quá nhiều ký tự đặc biệt ({k}/{n})"
REASON_ONLY_TAG = "chỉ còn [TÊN] không có nội dung"
REASON_DIGITS = "chỉ toàn số"
REASON_PUNCT = "chỉ toàn dấu câu"
REASON_OK = "hợp lệ"
NAME_TAG_VI = "[TÊN]"
NAME_TAG = "[NAME]"

# --- fixed values: Vietnamese letters ---------------------------------------
VI_LOWER = (
    "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
)
VI_UPPER = (
    "ÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÉÈẺẼẸÊẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴĐ"
)
# Letters that may start a later word of a masked name in the cleaning chain:
# capitals up to Ộ, and both the lower-case horn letters and the rest below.
NAME_START_VI = "A-ZÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÉÈẺẼẸÊẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌÔỐỒỔỖỘơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
NAME_UPPER = "A-ZĐÂÊÔƠƯÁÀẢÃẠẤẦẨẪẬẮẰẲẴẶÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
REPEATABLE_UPPER = (
    "AÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬEÉÈẺẼẸÊẾỀỂỄỆIÍÌỈĨỊOÓÒỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢUÚÙỦŨỤƯỨỪỬỮỰYÝỲỶỸỴD"
)

# --- fixed values: people ---------------------------------------------------
CLEANING_SURNAMES = (
    "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý"
).split()
SURNAMES = (
    "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý "
    "Đinh Đoàn Trịnh Trương Lâm Mai Tô Tăng Chu Cao"
).split()
HONORIFICS = [
    "thầy", "cô", "anh", "chị", "em", "bạn", "ông", "bà", "chú", "dì", "cậu", "mợ",
    "bác", "sếp", "sư", "sinh viên", "học sinh", "giáo viên", "giảng viên",
]
TOKEN_HONORIFICS = HONORIFICS + ["mr", "mrs", "ms"]
FUNCTION_WORDS = (
    "là và với của cho này đó rồi không có đã sẽ đang vẫn cũng chỉ mà nhưng nếu thì "
    "nên phải ơi à nhé nhỉ vậy sao đâu gì ai khi trong ngoài trên dưới giữa"
).split()

# --- fixed values: emoji to feeling word (first-stage cleaning) -------------
EMOJI_WORDS = """
😍 yêu_thích
🥰 yêu_thích
😘 yêu_thích
❤️ yêu_thích
🧡 yêu_thích
💛 yêu_thích
💚 yêu_thích
💙 yêu_thích
💜 yêu_thích
🖤 yêu_thích
🤍 yêu_thích
💕 yêu_thích
💞 yêu_thích
💓 yêu_thích
💗 yêu_thích
💖 yêu_thích
💝 yêu_thích
😊 vui_vẻ
😄 vui_vẻ
😁 vui_vẻ
😀 vui_vẻ
🥳 vui_vẻ
🎉 vui_vẻ
🎊 vui_vẻ
🤩 vui_vẻ
😎 tự_hào
💪 mạnh_mẽ
🙌 đồng_tình
👏 tán_thưởng
👍 đồng_ý
✅ đồng_ý
🌟 xuất_sắc
⭐ xuất_sắc
🔥 ấn_tượng
✨ tuyệt_vời
🙏 biết_ơn
😌 nhẹ_nhõm
🥹 xúc_động
😇 hạnh_phúc
🤗 vui_mừng
😡 tức_giận
😤 bực_bội
🤬 tức_giận_mạnh
💢 tức_giận
😠 khó_chịu
😢 buồn_bã
😭 khóc
💔 đau_lòng
🥺 tội_nghiệp
😞 thất_vọng
😔 buồn
😟 lo_lắng
😕 bối_rối
🙁 không_vui
☹️ buồn
😒 thờ_ơ
🙄 chán_nản
😑 vô_cảm
😐 bình_thường
😨 sợ_hãi
😱 kinh_hoàng
😰 lo_âu
😓 mệt_mỏi
😩 kiệt_sức
😫 mệt_mỏi
🤢 khó_chịu
🤮 ghê_tởm
😷 bệnh
🤧 ốm
👎 không_đồng_ý
💀 chết_rồi
🗑️ rác
😂 hài_hước
🤣 hài_hước
😆 buồn_cười
😅 ngại_ngùng
🤔 suy_nghĩ
😶 im_lặng
😏 mỉa_mai
🤷 không_biết
😴 buồn_ngủ
💤 ngủ
🤯 bất_ngờ
😲 ngạc_nhiên
😮 ngạc_nhiên
🫤 phân_vân
🫠 tan_chảy
"""

# --- fixed values: safe abbreviations, applied in this order ------------------
SAFE_ABBREVIATIONS = [
    ("ko", "không"), ("k", "không"), ("hk", "không"), ("kg", "không"), ("khg", "không"),
    ("đc", "được"), ("dc", "được"), ("mk", "mình"), ("mik", "mình"), ("mh", "mình"),
    ("bn", "bạn"), ("bạn ơi", "bạn"), ("vs", "với"), ("nt", "như thế"),
    ("ntn", "như thế nào"), ("ns", "nói"), ("nói chuyện", "nói chuyện"),
    ("bt", "bình thường"), ("trc", "trước"), ("r", "rồi"), ("ờ r", "ờ rồi"),
    ("xong r", "xong rồi"), ("đi r", "đi rồi"), ("bh", "bây giờ"), ("h", "giờ"),
    ("ngta", "người ta"), ("ng ta", "người ta"), ("ng", "người"), ("nhìu", "nhiều"),
    ("nhiu", "nhiều"), ("bik", "biết"), ("bit", "biết"), ("hiu", "hiểu"), ("hỉu", "hiểu"),
    ("thui", "thôi"), ("thoy", "thôi"), ("zậy", "vậy"), ("vy", "vậy"), ("ik", "đi"),
    ("đi ik", "đi đi"), ("lm", "làm"), ("lm ơn", "làm ơn"), ("ms", "mới"), ("mới ms", "mới mới"),
]

# --- fixed values: lines that are not content ---------------------------------
NOISE_LINES = [
    "DNTU - Confession", "Thu gọn", "See less", "Xem thêm", "See more",
    "Xem thêm bình luận", "View more comments", "Tất cả cảm xúc:", "All reactions:",
    "Thích", "Like", "Bình luận", "Comment", "Chia sẻ", "Share",
]
COMPOSER_PROMPTS = ["Bình luận dưới tên", "Viết bình luận", "Comment as", "Write a comment"]
DATE_LINE = r"^\d{1,2}\s*(tháng|thg)\b"
DATE_WORDS = (
    r"tháng|giờ|phút|ngày|tuần|năm|vừa xong|hôm qua|yesterday|just now|\b\d{4}\b|\b\d+\s*[hmdwy]\b"
)
COUNT_TEXT = r"[\d][\d.,]*\s?[KkMmNnTr]*"

# --- fixed values: emoji names used as tags (others take the Unicode name) -----
EMOJI_TAGS = """
😃 grinning_face_with_big_eyes
😄 grinning_face_with_smiling_eyes
😁 beaming_face_with_smiling_eyes
😆 grinning_squinting_face
😅 grinning_face_with_sweat
🥰 smiling_face_with_hearts
😍 smiling_face_with_heart_eyes
😘 face_blowing_a_kiss
😋 face_savoring_food
😛 face_with_tongue
😜 winking_face_with_tongue
😝 squinting_face_with_tongue
🤪 zany_face
🤨 face_with_raised_eyebrow
🤭 face_with_hand_over_mouth
🤩 star_struck
🤮 face_vomiting
🥺 pleading_face
😤 face_with_steam_from_nose
😡 enraged_face
😰 anxious_face_with_sweat
😥 sad_but_relieved_face
😓 downcast_face_with_sweat
☹ frowning_face
☺ smiling_face
👍 thumbs_up
👎 thumbs_down
👌 ok_hand
👏 clapping_hands
🙏 folded_hands
🙌 raising_hands
🙋 person_raising_hand
🤦 person_facepalming
👉 backhand_index_pointing_right
☝ index_pointing_up
❤ red_heart
♥ heart_suit
⭐ star
🎁 wrapped_gift
💯 hundred_points
✅ check_mark_button
✔ check_mark
⚠ warning
☎ telephone
⚡ high_voltage
☀ sun
🏻 light_skin_tone
🏼 medium_light_skin_tone
🏽 medium_skin_tone
🏾 medium_dark_skin_tone
🏿 dark_skin_tone
"""
EMOJI_RANGES = [(0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2300, 0x23FF), (0x2B00, 0x2BFF)]
EMOJI_SINGLES = [0x203C, 0x2049, 0x2122, 0x2139, 0x3030, 0x303D, 0x3297, 0x3299]
TAG_DIGITS = "zero one two three four five six seven eight nine".split()

# --- fixed values: sentiment preprocessing patterns ----------------------------
EMOTICONS = [
    (r"(?i)(?:x|=|:)-?d+", " <laugh_emoticon> "),
    (r"(?:=|:|;)-?\)+", " <smile_emoticon> "),
    (r"(?:=|:|;)-?\(+", " <sad_emoticon> "),
    (r"(?i)t[_\-.]?t", " <cry_emoticon> "),
    (r"<3+", " <heart_emoticon> "),
]
HEART_PLACEHOLDER = "heartemoticonplaceholder"
BARE_URL = (
    r"(?:https?://|www\.)\S+|(?:[a-z0-9][a-z0-9._-]+\.(?:com|vn|edu|net|org|io|co)(?:/\S*)?)"
)
POST_ID_HASHTAGS = [
    r"#\s*\d{3,}\b",
    r"#\s*\d{1,2}(?=[A-Za-zÀ-ỹĐđ])",
    r"#\s*(?:cfs|csf|cts)_?\d{3,5}(?:_?(?:dntu|dtnu))?",
]
IGNORED_HASHTAGS = [r"^#cfs\d+_dntu", r"^#\d+$"]
DIGIT_WORDS = "không một hai ba bốn năm sáu bảy tám chín".split()
UNIT_WORDS = {
    "k": "k", "m": "m", "b": "b", "tr": "triệu", "trieu": "triệu", "ty": "tỷ",
    "đ": "đồng", "d": "điểm", "vnd": "đồng", "t": "tuổi", "p": "phút", "ph": "phút",
    "h": "giờ", "g": "giờ", "s": "giây", "kg": "kg", "gr": "gram", "km": "km",
    "cm": "cm", "mm": "mm", "gb": "gb", "mb": "mb", "kb": "kb",
}
UNIT_LETTERS = "a-zà-ỹđ"
MOJIBAKE_MARKS = ["Ã", "Â", "á»", "Ä", "Æ"]

# --- fixed values: triage words and answers -----------------------------------
URGENT_WORDS = ["khung hoang", "canh bao", "bao luc", "khieu nai", "gap", "nguy hiem", "lua dao"]
STUDY_WORDS = ["lich hoc", "diem", "thi", "hoc phi", "phong hoc"]
ACTIVITY_WORDS = ["tinh nguyen", "su kien", "ngay hoi", "clb", "hoat dong"]
NEGATIVE_WORDS = ["khong hai long", "te", "loi", "that vong", "buc xuc"]
POSITIVE_WORDS = ["tot", "cam on", "hay", "tich cuc"]
SUMMARY_LENGTH = 220
EMPTY_SUMMARY = "Khong co noi dung de tom tat."
ACTION_URGENT = "Can bo CTSV can xem va phan cong xu ly som."
ACTION_WATCH = "Theo doi va cap nhat trang thai khi can."
RULE_PROVIDER = "mock"
RULE_MODEL = "rule-based-demo"
UNSORTED_TOPIC = "chua_phan_loai"
UNLABELLED = "chua_label"

# --- fixed values: report headings -----------------------------------------------
REPORT_COLUMNS = {
    "id": "ID", "source_id": "Nguon", "content": "Noi dung", "topic": "Chu de",
    "importance_level": "Muc do", "status": "Trang thai", "collected_at": "Ngay thu thap",
}
PAD, UNK = "<pad>", "<unk>"
