"""Fixed values of the mail-triage rules. Changing one changes results."""

# --- fixed values: white space (Python's str.isspace set), as characters and as a regex class body ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_IN_LINE = r"\t\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# --- fixed values: header defaults ---
DEFAULT_ADDRESS = "N/A"
DEFAULT_SUBJECT = "No Subject Detected"
DEFAULT_SENDER = "noreply@example.com"
DEFAULT_CONFIG_SET = "AWS-SES-Send-Email"

# --- fixed values: model contract ---
REQUEST_VERSION_FIELD = "anthropic_version"
REQUEST_VERSION = "bedrock-2023-05-31"
MAX_TOKENS = 2000
TEMPERATURE = 0.7
PHISHING = "PHISHING"
CLEAN = "CLEAN"
RED_FLAGS = "RED FLAGS"
SIMILAR_THREATS = "HOW TO IDENTIFY SIMILAR THREATS"
CLEAN_INDICATORS = "CLEAN INDICATORS"
SECTION_OPEN = "[SECTION]"
SECTION_CLOSE = "[/SECTION]"
SERVICE_ERROR_TEXT = "Error: Unable to process the email content. (%s)"
UNEXPECTED_ERROR_TEXT = "Error: Unexpected error occurred during email classification."

# --- fixed values: HTML of an analysis ---
VERDICT_BOX = ("<div class='verdict'><h3>", "</h3></div>")
SECTION_TITLE = "<h3 class='{style}'>{name}</h3>"
LIST_MARKS = ("<ul>", "</ul>")
ITEM_MARKS = ("<li>", "</li>")
BOLD_MARKS = ("<strong>", "</strong>")
BULLETS = ("\u2022", "*", "-")
PHISHING_STYLE = "red-section"
CLEAN_STYLE = "green-section"

# --- fixed values: reply, ticket and outcome texts ---
REPLY_TAG_PHISHING = "[PHISHING Detected] "
REPLY_TAG_CLEAN = "[CLEAN] "
TICKET_TAG_PHISHING = "[PHISHING] "
TICKET_TAG_CLEAN = "[CLEAN] "
TICKET_LABELS = ("phishing-email", "catch-all")
STATUS_OK_TEXT = "Email processed successfully"
STATUS_ERROR_PREFIX = "Error processing email: "

# --- fixed values: what is redacted, applied in this order. These are the plain patterns with Python's
# meaning of \b, \d and \s; functions.text has the forms that Spark runs ---
REDACTIONS = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE]"),
    (r"https?://\S+", "[URL]"),
    (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CREDIT_CARD]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
)

# --- fixed values: HTML-to-text replacements, applied one after the other in this order ---
TAG_REPLACEMENTS = (
    ("<br>", "\n"),
    ("<hr>", "-" * 40),
    ("<h1>", ""),
    ("</h1>", "\n\n"),
    ("<h2>", ""),
    ("</h2>", "\n"),
    ("<h3>", ""),
    ("</h3>", "\n"),
    ("<p>", ""),
    ("</p>", "\n"),
    ("<strong>", ""),
    ("</strong>", ""),
    ("<div>", ""),
    ("</div>", "\n"),
)

# --- fixed values: metadata of a replay notification ---
NOTIFICATION_VERSION = "2.1"
NOTIFICATION_SOURCE = "aws:s3"
NOTIFICATION_REGION = "us-east-1"
NOTIFICATION_TIME = "2023-01-01T00:00:00.000Z"
NOTIFICATION_NAME = "ObjectCreated:Put"
NOTIFICATION_PRINCIPAL = "MANUAL_TRIGGER"
NOTIFICATION_ADDRESS = "127.0.0.1"
NOTIFICATION_REQUEST_ID = "manual-request"
NOTIFICATION_TAG = "manual-trigger"
NOTIFICATION_SCHEMA_VERSION = "1.0"
NOTIFICATION_CONFIGURATION = "manual-trigger-event"
NOTIFICATION_ARN_PREFIX = "arn:aws:s3:::"
