"""Values fixed by the wire and text formats the engine has to be compatible with."""

# Recognition patterns, in priority order.
ID_CARD_REGEX = r"\p{Nd}{17}[\p{Nd}Xx]"
BANK_CARD_REGEX = r"\p{Nd}{16,19}"
PHONE_REGEX = r"1[3-9]\p{Nd}{9}"
EMAIL_REGEX = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Confidences of the two recognisers.
PATTERN_CONFIDENCE = 1.0
ENTITY_CONFIDENCE = 0.8

# Entity label -> data type.
ENTITY_TYPES = {"PERSON": "name", "GPE": "address", "LOC": "address", "FAC": "address"}

# Placeholders of the replace strategy.
PLACEHOLDERS = {
    "name": "[姓名]",
    "id_card": "[身份证]",
    "phone": "[电话]",
    "address": "[地址]",
    "bank_card": "[银行卡]",
    "email": "[邮箱]",
}
DEFAULT_PLACEHOLDER = "[敏感信息]"

# Characters that end a province / city / district in an address.
PROVINCE_CITY = "省市"
CITY_DISTRICT = "市区县"
ADDRESS_TAIL = "******"

# Rules seeded into an empty rule store (name, data type), all "mask".
SEED_RULES = [
    ("姓名脱敏（掩码）", "name"),
    ("身份证脱敏（掩码）", "id_card"),
    ("手机号脱敏（掩码）", "phone"),
    ("地址脱敏（掩码）", "address"),
    ("银行卡脱敏（掩码）", "bank_card"),
    ("邮箱脱敏（掩码）", "email"),
]

# Rules of a batch run without stored rules (id, name, data type), all "mask".
FALLBACK_RULES = [
    ("rule_name", "姓名脱敏", "name"),
    ("rule_phone", "手机号脱敏", "phone"),
    ("rule_id_card", "身份证脱敏", "id_card"),
    ("rule_address", "地址脱敏", "address"),
    ("rule_bank_card", "银行卡脱敏", "bank_card"),
    ("rule_email", "邮箱脱敏", "email"),
]

# Domains of the enumerated columns.
FILE_TYPES = ["pdf", "docx", "xlsx", "txt", "md"]
TASK_STATUSES = ["uploaded", "parsed", "identified", "completed", "failed"]
DATA_TYPES = ["name", "id_card", "phone", "address", "bank_card", "email"]
STRATEGIES = ["mask", "replace", "delete"]
OPERATIONS = ["upload", "desensitization", "download"]

# Intake limits and routes.
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".xlsx", ".txt", ".md"]
MAX_FILE_SIZE = 52_428_800
PARSED_TYPES = ["pdf", "docx", "xlsx", "txt"]
EXPORT_FORMATS = ["txt", "md", "docx", "xlsx"]
FALLBACK_ENCODINGS = ["gbk", "gb2312", "latin-1"]

# Layout-text conventions.
SHEET_PREFIX = "=== Sheet:"
SHEET_SUFFIX = "==="
CELL_SEPARATOR = " | "
DEFAULT_SHEET = "Sheet1"
SHEET_TITLE_LIMIT = 31
OUTPUT_SUFFIX = "_desensitized"

# Censoring of log maps.
CENSORED_KEYS = ["password", "token", "secret", "api_key", "auth"]
CENSORED = "***CENSORED***"

# Messages of files that fail, by error code; the last two end with the file's type.
ERROR_MESSAGES = {
    "EMPTY_DOCUMENT": "TXT file is empty",
    "NO_CONTENT": "No text content found in TXT file",
    "ENCODING_ERROR": "Text encoding could not be determined",
    "FILE_SIZE_EXCEEDED": "File size exceeds maximum limit",
    "UNSUPPORTED_FORMAT": "Unsupported file type: ",
    "ASSEMBLED_ELSEWHERE": "Read by the assembly operators: ",
}
TYPED_MESSAGES = ["UNSUPPORTED_FORMAT", "ASSEMBLED_ELSEWHERE"]
