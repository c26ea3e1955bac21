"""They decide results, so they are listed here as plain text."""

from decimal import Decimal

# --- fixed values: list thresholds (key -> seeded value) --------------------
LIST_SETTINGS = {
    "quote_min_age_days": Decimal("7"),
    "quote_max_age_days": Decimal("90"),
    "quote_min_value": Decimal("2500"),
    "quiet_min_invoices_12m": Decimal("6"),
    "quiet_overdue_factor": Decimal("1.5"),
    "quiet_min_days": Decimal("21"),
    "quiet_max_days": Decimal("180"),
    "reorder_min_orders": Decimal("4"),
    "reorder_min_days": Decimal("14"),
    "reorder_overdue_factor": Decimal("1.5"),
    "reorder_dead_factor": Decimal("4"),
    "reorder_min_value_12m": Decimal("2000"),
    "new_account_days": Decimal("45"),
    "gap_top_accounts": Decimal("10"),
    "gap_min_pct": Decimal("25"),
}

# --- fixed values: activity types offered for a task (code, label, sort) -----
TASK_TYPES = [
    ("CUST_FU", "Follow up with customer", 1),
    ("QUOTE FU", "Quote follow-up", 2),
    ("CALL", "Call", 3),
    ("VISIT", "Visit", 4),
    ("MTG", "Meeting", 5),
    ("QUOTE", "Quote", 6),
    ("SUBMITTAL", "Submittal", 7),
    ("PRE-BID", "Pre-bid", 8),
    ("COMPLAINT", "Complaint", 9),
]
DEFAULT_TASK_TYPE = "CUST_FU"

# --- fixed values: ERP codes ---------------------------------------------------
DOCUMENT_KINDS = {"quote": 709, "order": 222, "opportunity": 2714}
LINK_CUSTOMER = 1203

# --- fixed values: peer analysis ------------------------------------------------
MIN_SIMILARITY = 0.3
LOOKALIKES = 40
GAP_ROWS = 40
GAP_MIN_PCT = 15
NEVER_BOUGHT = "never bought"
BOUGHT_BEFORE = "bought before, not in last 12 months"

# --- fixed values: name search ---------------------------------------------------
MIN_NAME_SIMILARITY = 0.2
FUZZY_MIN_LENGTH = 3
EXACT_ROWS = 10
FUZZY_ROWS = 8
FUZZY_NOTE = "fuzzy match: confirm with the user if unsure"

# --- fixed values: row limits that are part of a report -------------------------
NEAR_ROWS = 25
TOOL_ROWS = 40
TOP_GROUPS = 12
TOP_ITEMS = 4
TASK_FEED_ROWS = 200
SELECT_ROWS = 200
SELECT_SECONDS = 30
SECTION_ROWS = 8
GAP_SECTION_ROWS = 12
VOCABULARY_NAMES = 250
VOCABULARY_MIN_PCT = 5

# --- fixed values: week list sections in display order (key, title) -------------
SECTIONS = [
    ("stale_quotes", "Quotes to chase"),
    ("going_quiet", "Gone quiet"),
    ("reorder_due", "Reorder due"),
    ("category_gaps", "Gaps"),
    ("tasks", "Your tasks"),
    ("new_accounts", "New accounts"),
]

# --- what each section says about itself, in this library's own words ------------
SECTION_BLURBS = {
    "stale_quotes": "Quotes still open one to thirteen weeks after they were made, the largest amounts first.",
    "going_quiet": "Accounts whose last invoice lies further back than their own rhythm of buying leads one to expect.",
    "reorder_due": "Product groups that an account buys at steady intervals and whose next order is overdue.",
    "category_gaps": "Product groups that the most similar customers buy and your largest accounts do not.",
    "tasks": "Tasks assigned to you that are not done yet, including those still waiting to be written to the ERP.",
    "new_accounts": "Accounts invoiced for the first time in the past six weeks; a good moment to ask for the second order.",
}

# --- fixed values: words a free-form statement may not contain ------------------
FORBIDDEN_WORDS = [
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "copy",
    "call", "do", "execute", "pg_sleep", "dblink", "set", "reset", "vacuum", "analyze", "listen",
    "notify", "refresh",
]
FORBIDDEN_PREFIXES = [
    "pg_read", "pg_write", "pg_ls", "pg_stat_file", "pg_terminate", "pg_cancel", "lo_", "set_config",
    "current_setting",
]
# Spark functions that call arbitrary JVM code
FORBIDDEN_SPARK_FUNCTIONS = ["reflect", "try_reflect", "java_method"]

# --- fixed values: reasons given by the checks -----------------------------------
STATEMENT_TARGET = r"(?U)\b(?:from|join)\s+([a-z_][a-z0-9_.]*)"
STATEMENT_WITH = r"(?U)(?:with|,)\s*([a-z_][a-z0-9_]*)\s+as\s*\("
STATEMENT_EMPTY = "empty statement"
STATEMENT_SEMICOLON = "one statement only, no semicolons"
STATEMENT_START = "must start with SELECT or WITH"
STATEMENT_FORBIDDEN = "read-only: statement contains a forbidden keyword"
STATEMENT_COMMENT = "comments not allowed"

# Name space of the scoped views in free-form statements
VIEW_SCHEMA = "book"
