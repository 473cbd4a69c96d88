"""Vocabularies, cues and thresholds that results depend on."""

# --- fixed values: types and labels
OUTPUT_TYPES = ["TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"]
ASSERTION_TYPES = ["CHẨN_ĐOÁN", "THUỐC", "TRIỆU_CHỨNG"]
CODEABLE_TYPES = ["CHẨN_ĐOÁN", "THUỐC"]
NO_CODE_TYPES = ["TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM"]
LABEL_TYPES = {"THUOC": "THUỐC", "TRIEU_CHUNG": "TRIỆU_CHỨNG", "BENH": "CHẨN_ĐOÁN", "XET_NGHIEM": "TÊN_XÉT_NGHIỆM", "KET_QUA_XET_NGHIEM": "KẾT_QUẢ_XÉT_NGHIỆM"}
ASSERTIONS = ["isNegated", "isFamily", "isHistorical"]
MARK_ALIASES = {"DX": "CHẨN_ĐOÁN", "SYM": "TRIỆU_CHỨNG", "DRUG": "THUỐC", "TEST": "TÊN_XÉT_NGHIỆM", "RES": "KẾT_QUẢ_XÉT_NGHIỆM"}
TEXT_LABELS = ["BENH", "THUOC"]
UNSCORED_LABELS = ["BENH_NHAN", "TAC_NHAN_NGOAI_SINH"]

# --- fixed values: context cues
NEGATION_CUES = ["Không", "Không có", "Không kèm", "Không phải", "Phủ nhận", "Chưa ghi nhận"]
HISTORY_HEADINGS = ["Tiền sử bệnh", "Thuốc trước khi nhập viện", "Các bệnh lý mạn tính", "Tiền sử bệnh nội khoa", "Các thủ thuật đã thực hiện", "Tiền sử", "TS bệnh", "TS nội khoa", "TS"]
FAMILY_HEADINGS = ["Tiền sử gia đình", "TS gia đình", "TS GĐ", "Tiền sử GĐ"]
CHECK_NEGATION_CUES = ["không", "chưa", "ko", "phủ nhận", "loại trừ", "âm tính"]
CHECK_HISTORY_CUES = ["tiền sử", "trước đây", "đã từng"]
CUE_WINDOW = 30

# --- fixed values: drug strings and terminologies
ROUTES = ["po", "iv", "im", "sc", "sq", "sl", "pr", "top", "inh", "ng", "pv", "id", "neb", "ophth", "otic", "nasal", "buccal", "rectal"]
FREQUENCIES = ["daily", "bid", "tid", "qid", "qd", "qod", "qhs", "qam", "qpm", "prn", "once", "weekly", "monthly", "hs", "ac", "pc", "stat"]
EVERY_HOURS = r"^q\d+h$"
DRUG_KINDS = ["IN", "PIN", "MIN", "SCD", "SBD", "BN"]
SUGGESTION_KINDS = ["SCD", "SBD", "GPCK", "BPCK", "BN", "PIN", "IN"]

# --- fixed values: patterns (word characters by Unicode class)
ATOM = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"
PHRASE_TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[-'’][\p{L}\p{M}\p{N}_]+)*"
HEADING = r"(?m)^([^\n:]{2,40}):"
LIST_MARKER = r"^[\s>]*(?:(?:\d+|[a-zA-Z])[.)]\s*|[-–—•*+]\s*)+"
CAPS_SECTION = r"(?:^|[,.])\s*([A-Z][A-Z0-9 /&'\-]{2,40}):\s*,?\s*"
SENTENCE_ENDS = [".", ";", "!", "?", ":", "…"]
HEADING_LINE = r"(?m)^[^\n]{3,40}:\s*$"
BOLD_MARK, HEADING_MARK = r"\*\*(?!\*)", r"(?m)^#{1,6}[ ]*"
BEFORE_ITEM = r"\s*,\s*(?=\d+\.\s)"
BEFORE_SUBHEAD = r"[ \t]*[.,][ \t]*(?=(?:[A-Z]{2,}[A-Z /]*|[A-Z][a-z]+(?: [A-Za-z]+){0,3}):)"
STOP_AND_COMMA = r"\.[ \t]*,[ \t]*"

# --- fixed values: weights and cutoffs
WEIGHTS = {"text": 0.3, "assertions": 0.3, "candidates": 0.4}
DRUG_CUTOFF, DISEASE_CUTOFF = 55.0, 60.0
DENSE_MARGIN, DENSE_MIN = 0.2, 0.2
FUZZY_MARGIN, FUZZY_MIN = 0.15, 0.55
MISMATCH_CUTOFF = 55.0
LOOKUP_CUTOFF, DENSE_LOOKUP_CUTOFF = 90.0, 50.0
MASK_RATE, FORM_RATE = 0.30, 0.20
