"""The same results in DuckDB SQL, computed from the tables' columns alone: no mail is composed or
parsed, and sections are found with window functions instead of array expressions."""

from __future__ import annotations

from mailtriage import constants as k
from mailtriage.templates import (
    PROMPT_TEMPLATE,
    REPORT_TEMPLATE,
    REPORT_THEME,
    TICKET_TEMPLATE,
    pieces,
)
from workload import queries as q
from workload import samples as s


def lit(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


NL = "chr(10)"
SPACE = lit(k.WHITESPACE)
CATCH_ALL = lit(s.CONFIG.catch_all)


def fill(template: str, **slots: str) -> str:
    parts = pieces(template, tuple(slots))
    return "(" + " || ".join(slots[text] if is_slot else lit(text) for text, is_slot in parts) + ")"


def redacted(text: str) -> str:
    for pattern, mask in k.REDACTIONS:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(mask)}, 'g')"
    return text


def plain_text(html: str) -> str:
    text = f"regexp_replace({html}, '<style>.*?</style>', '', 'gs')"
    for tag, replacement in k.TAG_REPLACEMENTS:
        text = f"replace({text}, {lit(tag)}, {lit(replacement)})"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    text = rf"regexp_replace({text}, '\n\s*\n', {NL} || {NL}, 'g')"
    return f"trim(regexp_replace({text}, ' +', ' ', 'g'), {SPACE})"


def item(line: str) -> str:
    bare = rf"regexp_replace(trim({line}, {SPACE}), '^\s*[•*\-]\s*', '')"
    return rf"regexp_replace({bare}, '\*\*(.*?)\*\*', '<strong>\1</strong>', 'g')"


def themed(flag: bool, analysis: str) -> str:
    text = REPORT_TEMPLATE
    for slot, value in REPORT_THEME[flag].items():
        text = text.replace("{" + slot + "}", value)
    return fill(text, analysis=analysis)


def report(flag: str, analysis: str) -> str:
    return f"CASE WHEN {flag} THEN {themed(True, analysis)} ELSE {themed(False, analysis)} END"


OBJECTS = f"""
    objects AS (
        SELECT doc_id, 'inbox/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS key, n_chars AS size,
               TIMESTAMP '2024-01-01' + to_seconds(doc_id * 7919 % 100000) AS last_modified
        FROM documents
    ),
    requested AS (
        SELECT CASE WHEN l.toxic = 1 THEN o.key || '.gone' ELSE o.key END AS key, doc_id
        FROM labels l JOIN objects o USING (doc_id)
    )"""

ENVELOPE = fill(
    "\nFrom: {sender}\nTo: {to}\nSubject: {subject}\n\n{body}\n",
    sender="sender",
    to="recipient",
    subject="subject",
    body="body",
)

# What the mail of each document says; the reply address comes from the outermost From header.
MAIL = f"""
    headers AS (
        SELECT doc_id AS msg_id, 'u' || doc_id || '@' || source || '.example.com' AS sender,
               'inbox@example.com' AS recipient, 'doc ' || doc_id || ' ' || lang AS subject,
               text AS body, lang, doc_id % 6 AS shape
        FROM documents
    ),
    mail AS (
        SELECT *, {ENVELOPE} AS envelope,
               CASE WHEN shape = 5 THEN {CATCH_ALL}
                    WHEN shape IN (3, 4) THEN 'user' || msg_id || '@example.com'
                    ELSE sender END AS reply_to
        FROM headers
    )"""

_RED = "[SECTION]RED FLAGS[/SECTION]\n"
_CLEAN = "[SECTION]CLEAN INDICATORS[/SECTION]\n"
_TIPS = "[SECTION]HOW TO IDENTIFY SIMILAR THREATS[/SECTION]\n"

ANSWERS = f"""
    answers AS (
        SELECT doc_id AS msg_id, CASE doc_id % 10
            WHEN 0 THEN {lit("PHISHING\n\n" + _RED + "- **Urgent** ")} || text
                        || {lit("\n• second\n" + _TIPS + "* tip")}
            WHEN 1 THEN {lit("CLEAN\n\n" + _CLEAN + "- ")} || text
            WHEN 2 THEN {lit("CLEAN\n" + _CLEAN + "- No phishing signs\n- ok\n")} || text
            WHEN 3 THEN {lit("**CLEAN**\n" + _CLEAN + "- ")} || text
            WHEN 4 THEN {lit("Verdict: suspicious\n" + _RED + "- ")} || text
            WHEN 5 THEN {lit("CLEAN\n" + _RED + "- ")} || text
            WHEN 6 THEN {lit("filler\n" * 20 + "PHISHING\n")} || text
            WHEN 7 THEN {lit("  \n")} || text
            WHEN 8 THEN {lit("PHISHING\n" + _RED + "- a\n" + _RED + "- b\n")} || text
            ELSE {lit("PHISHING\n" + _RED + "- This is PHISHING mail\n**Lead** x\n- kept\n")} || text
            END AS text
        FROM documents
    ),
    flags AS (
        SELECT msg_id, text, string_split(trim(text, {SPACE}), {NL}) AS lines,
               len(list_filter(lines[1:20], lambda l: contains(upper(l), 'PHISHING'))) > 0
               OR (len(list_filter(lines[1:5],
                                   lambda l: trim(upper(l), {SPACE}) IN ('PHISHING', 'CLEAN'))) = 0
                   AND contains(text, '[SECTION]RED FLAGS[/SECTION]')) AS is_phishing,
               regexp_extract(text, '(PHISHING|CLEAN)', 1) AS label
        FROM answers
    )"""

SECTIONS = (
    ANSWERS
    + rf""",
    lines AS (
        SELECT msg_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM flags
    ),
    marked AS (
        SELECT *, regexp_matches(line, '\[SECTION\](.*?)\[/SECTION\]') AS is_header,
               regexp_extract(line, '\[SECTION\](.*?)\[/SECTION\]', 1) AS name
        FROM lines
    ),
    numbered AS (
        SELECT *, sum(is_header::INT) OVER (PARTITION BY msg_id ORDER BY line_no) AS header_no FROM marked
    ),
    last_headers AS (
        SELECT msg_id, name AS section, max(header_no) AS header_no
        FROM numbered WHERE is_header AND name <> '' GROUP BY msg_id, name
    ),
    items AS (
        SELECT n.msg_id, h.section,
               row_number() OVER (PARTITION BY n.msg_id, h.section ORDER BY n.line_no) AS pos,
               {item("n.line")} AS item
        FROM numbered n JOIN last_headers h USING (msg_id, header_no)
        WHERE NOT n.is_header AND trim(n.line, {SPACE}) <> ''
          AND NOT contains(n.line, 'PHISHING') AND NOT contains(n.line, 'CLEAN')
    ),
    lists AS (
        SELECT msg_id, section,
               '<ul>' || {NL} || string_agg('<li>' || item || '</li>', {NL} ORDER BY pos)
               || {NL} || '</ul>' AS html
        FROM items GROUP BY msg_id, section
    ),
    analyses AS (
        SELECT f.msg_id, f.is_phishing, f.label,
               CASE WHEN f.label <> '' THEN '<div class=''verdict''><h3>' || f.label || '</h3></div>'
                    ELSE '' END
               || CASE WHEN f.is_phishing THEN
                      coalesce({NL} || '<h3 class=''red-section''>RED FLAGS</h3>' || {NL} || r.html, '')
                      || coalesce({NL} || '<h3 class=''red-section''>HOW TO IDENTIFY SIMILAR THREATS</h3>'
                                  || {NL} || t.html, '')
                  ELSE coalesce({NL} || '<h3 class=''green-section''>CLEAN INDICATORS</h3>'
                                || {NL} || c.html, '') END AS analysis
        FROM flags f
        LEFT JOIN lists r ON r.msg_id = f.msg_id AND r.section = 'RED FLAGS'
        LEFT JOIN lists t ON t.msg_id = f.msg_id AND t.section = 'HOW TO IDENTIFY SIMILAR THREATS'
        LEFT JOIN lists c ON c.msg_id = f.msg_id AND c.section = 'CLEAN INDICATORS'
    ),
    judged AS (
        SELECT msg_id, score_error, is_phishing AND score_error IS NULL AS is_phishing,
               CASE WHEN score_error IS NULL THEN label ELSE '' END AS label,
               coalesce(score_error, analysis) AS analysis
        FROM (SELECT *, CASE
                  WHEN msg_id % 20 = 7
                      THEN 'Error: Unable to process the email content. (ThrottlingException)'
                  WHEN msg_id % 10 = 7
                      THEN 'Error: Unexpected error occurred during email classification.'
                  END AS score_error
              FROM analyses)
    )"""
)

TRIAGE = (
    MAIL
    + ","
    + SECTIONS
    + """,
    triaged AS (
        SELECT msg_id, reply_to, envelope, is_phishing, label, analysis, score_error,
               CASE WHEN is_phishing THEN '[PHISHING Detected] ' ELSE '[CLEAN] ' END || subject
                   AS reply_subject
        FROM mail JOIN judged USING (msg_id)
    )"""
)
_DECISION = "msg_id, reply_to, reply_subject, is_phishing, label, analysis, score_error"


def _part(
    visit: int, message: int, root: bool, eml: bool, kind: str, headers: int, text: str, raw: str, pref: bool = False
) -> str:
    filename = "'m.eml'" if kind == "application/octet-stream" else "NULL"
    split = kind.startswith(("multipart/", "message/"))
    return (
        f"{{'visit_no': {visit}, 'message_no': {message}, 'is_root': {root}, 'in_eml': {eml},"
        f" 'content_type': {lit(kind)}, 'filename': {filename}::VARCHAR, 'n_headers': {headers},"
        f" 'is_multipart': {split}, 'body_pref': {pref}, 'text': {text}::VARCHAR, 'raw_text': {raw}::VARCHAR}}"
    )


def _forward(visit: int, message: int, kind: str, headers: int) -> list[str]:
    return [
        _part(visit, message, True, False, "multipart/mixed", 5, "NULL", "NULL"),
        _part(visit + 1, message, False, False, "text/plain", 2, "'please check'", "'please check'", True),
        _part(visit + 2, message, False, False, kind, headers, "NULL", "NULL"),
        _part(visit + 3, message + 1, True, kind != "message/rfc822", "text/plain", 6, "text", "text"),
    ]


_SHAPES = (
    [_part(0, 0, True, False, "text/plain", 6, "text", "text")],
    [
        _part(0, 0, True, False, "multipart/alternative", 5, "NULL", "NULL"),
        _part(1, 0, False, False, "text/plain", 2, "text", "text", True),
        _part(2, 0, False, False, "text/html", 2, "NULL", "'<p>' || lang || '</p>'"),
    ],
    [_part(0, 0, True, False, "text/html", 6, "NULL", "text")],
    _forward(0, 0, "message/rfc822", 1),
    _forward(0, 0, "application/octet-stream", 3),
    [_part(0, 0, True, False, "message/rfc822", 3, "NULL", "NULL"), *_forward(1, 1, "message/rfc822", 1)],
)
PARTS = " ".join(f"WHEN {shape} THEN [{', '.join(parts)}]" for shape, parts in enumerate(_SHAPES))

_UTF8 = 'charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'
_HEADERS = "'From: ' || sender || " + lit("\nTo: inbox@example.com\nSubject: ") + " || subject"
_PLAIN = f"({_HEADERS} || {lit('\nMIME-Version: 1.0\nContent-Type: text/plain; ' + _UTF8)} || body)"
_HTML = f"({_HEADERS} || {lit('\nMIME-Version: 1.0\nContent-Type: text/html; ' + _UTF8)} || body)"
_BOTH = fill(
    "{headers}\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=\"b{id}\"\n\n--b{id}\n"
    "Content-Type: text/plain; " + _UTF8 + "{body}\n--b{id}\nContent-Type: text/html; " + _UTF8
    + "<p>{lang}</p>\n--b{id}--\n",
    headers=_HEADERS,
    id="msg_id",
    body="body",
    lang="lang",
)


def _wrapped(kind: str, payload: str) -> str:
    return fill(
        f"From: user{{id}}@example.com\nTo: {s.RECIPIENT}\nSubject: Fwd\nMIME-Version: 1.0\n"
        'Content-Type: multipart/mixed; boundary="fb{id}"\n\n--fb{id}\n'
        "Content-Type: text/plain; " + _UTF8 + f"please check\n--fb{{id}}\n{kind}\n\n{{payload}}\n--fb{{id}}--\n",
        id="msg_id",
        payload=payload,
    )


_MESSAGE = _wrapped("Content-Type: message/rfc822", _PLAIN)
_FILE = _wrapped(
    'Content-Type: application/octet-stream\nContent-Disposition: attachment; filename="m.eml"\n'
    "Content-Transfer-Encoding: base64",
    "payload",
)
_NESTED = f"{lit('Subject: Fwd\nMIME-Version: 1.0\nContent-Type: message/rfc822\n\n')} || {_MESSAGE}"
# Spark breaks base64 text into lines of 76 characters.
_BASE64 = rf"rtrim(regexp_replace(to_base64(encode({_PLAIN})), '(.{{76}})', '\1' || chr(13) || chr(10), 'g'), chr(13) || chr(10))"

# Text that is not ASCII is written again in base64, in lines of 76 characters.
_REWRITTEN = (
    f"({_HEADERS} || {lit('\nMIME-Version: 1.0\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n')}"
    rf" || rtrim(regexp_replace(to_base64(encode(body)), '(.{{76}})', '\1' || {NL}, 'g'), {NL}) || {NL})"
)

ORACLE: dict[str, str] = {
    "email_scan": f"""
        WITH {MAIL},
        raw AS (SELECT msg_id, CASE shape WHEN 0 THEN {_PLAIN} WHEN 1 THEN {_BOTH} WHEN 2 THEN {_HTML}
                    WHEN 3 THEN {_MESSAGE} WHEN 4 THEN {_FILE} ELSE {_NESTED} END AS content
                FROM (SELECT *, {_BASE64} AS payload FROM mail))
        SELECT msg_id, strlen(content)::INT AS size, md5(content) AS checksum FROM raw""",
    "triage_stream": f"WITH {TRIAGE} SELECT {_DECISION} FROM triaged",
    "object_listing": f"""
        WITH {OBJECTS},
        page AS (SELECT * FROM objects WHERE starts_with(key, {lit(q.PREFIX)})
                 ORDER BY key LIMIT {q.MAX_ITEMS})
        SELECT row_number() OVER (ORDER BY last_modified, key)::INT AS number, key, size,
               CASE WHEN size < 1024 THEN printf('%.2f B', size::DOUBLE)
                    WHEN size < 1048576 THEN printf('%.2f KB', size / 1024.0)
                    ELSE printf('%.2f MB', size / 1048576.0) END AS size_label,
               strftime(last_modified, '%Y-%m-%d %H:%M:%S') AS last_modified,
               's3://{s.BUCKET}/' || key AS path
        FROM page""",
    "listing_summary": f"""
        WITH {OBJECTS}
        SELECT least(count(*), {q.MAX_ITEMS}) AS returned, count(*) = 0 AS is_empty,
               count(*) > {q.MAX_ITEMS} AS truncated
        FROM objects WHERE starts_with(key, {lit(q.PREFIX)})""",
    "size_label": "SELECT doc_id, "
    + ", ".join(
        f"""CASE WHEN n_chars * {times} < 1024 THEN printf('%.2f B', (n_chars * {times})::DOUBLE)
            WHEN n_chars * {times} < 1048576 THEN printf('%.2f KB', n_chars * {times} / 1024::DOUBLE)
            WHEN n_chars * {times} < 1073741824 THEN printf('%.2f MB', n_chars * {times} / 1048576::DOUBLE)
            ELSE printf('%.2f GB', n_chars * {times} / 1073741824::DOUBLE) END AS {name}"""
        for times, name in ((1, "label"), (1000, "label_thousand"), (1000000, "label_million"))
    )
    + " FROM documents",
    "missing_objects": f"""
        WITH {OBJECTS} SELECT key, doc_id FROM requested
        WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.key = requested.key)""",
    "present_objects": f"""
        WITH {OBJECTS} SELECT key, doc_id FROM requested
        WHERE EXISTS (SELECT 1 FROM objects o WHERE o.key = requested.key)""",
    "notification_parse": f"""
        WITH {OBJECTS}
        SELECT doc_id, CASE WHEN doc_id % 4 <> 2 THEN '{s.BUCKET}' END AS bucket,
               CASE doc_id % 4 WHEN 2 THEN NULL WHEN 3 THEN key || '%20x' ELSE key END AS key,
               CASE WHEN doc_id % 4 = 2 THEN 'no object in notification' END AS error
        FROM objects""",
    "replay_manifest": f"""
        WITH {OBJECTS}
        SELECT key, key AS object_key, '{s.BUCKET}' AS bucket, 'arn:aws:s3:::{s.BUCKET}' AS arn,
               'ObjectCreated:Put' AS event_name, '2023-01-01T00:00:00.000Z' AS event_time,
               'MANUAL_TRIGGER' AS principal, '0' AS size, true AS null_version
        FROM objects""",
    "replay_batch": """
        SELECT doc_id AS msg_id, 200 AS status, '"Email processed successfully"' AS status_body
        FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 0) USING (doc_id)""",
    "recipient_filter": "SELECT doc_id AS msg_id FROM documents WHERE doc_id % 6 IN (3, 4)",
    "email_parts": f"""
        SELECT msg_id, unnest(part) FROM (
            SELECT doc_id AS msg_id, unnest(CASE doc_id % 6 {PARTS} END) AS part FROM documents)""",
    "original_message": f"""
        WITH {MAIL}
        SELECT msg_id, CASE WHEN shape < 3 THEN 0 WHEN shape < 5 THEN 1 ELSE 2 END AS message_no,
               CASE WHEN shape = 1 THEN 5 ELSE 6 END AS n_headers, shape = 1 AS is_multipart
        FROM mail""",
    "mail_headers": f"WITH {MAIL} SELECT msg_id, sender, recipient, subject FROM mail",
    "reply_address": f"WITH {MAIL} SELECT msg_id, reply_to FROM mail",
    "mail_body": f"WITH {MAIL} SELECT msg_id, body FROM mail",
    "mail_envelope": f"WITH {MAIL} SELECT msg_id, envelope FROM mail",
    "body_preview": f"""
        WITH {MAIL}
        SELECT msg_id, CASE WHEN length(body) > {q.PREVIEW}
            THEN substr(body, 1, {q.PREVIEW}) || {NL} || {NL} || '[... ' || (length(body) - {q.PREVIEW})
                 || ' more characters ...]'
            ELSE body END AS preview
        FROM mail""",
    "text_parts": f"""
        WITH {MAIL},
        written AS (SELECT *, CASE WHEN regexp_matches(body, '[^\\x00-\\x7F]') THEN {_REWRITTEN} ELSE {_PLAIN} END AS source
                    FROM mail)
        SELECT msg_id, CASE WHEN shape IN (0, 2) THEN body
            WHEN shape = 1 THEN body || {NL} || '<p>' || lang || '</p>'
            WHEN shape = 4 THEN 'please check'
            WHEN shape = 3 THEN 'please check' || {NL} || source || {NL} || body
            ELSE {_wrapped("Content-Type: message/rfc822", "source")} || {NL} || 'please check' || {NL} || source
                 || {NL} || body END AS dump
        FROM written""",
    "raw_dump": f"""
        WITH {MAIL.replace("text AS body", "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS body")}
        SELECT msg_id, CASE shape WHEN 0 THEN {_PLAIN} WHEN 1 THEN {_BOTH} WHEN 2 THEN {_HTML} WHEN 3 THEN {_MESSAGE}
                   WHEN 4 THEN replace({_FILE}, chr(13), '') ELSE {_NESTED} END AS dump
        FROM (SELECT *, {_BASE64} AS payload FROM mail)""",
    "edge_mail": f"""
        SELECT doc_id AS msg_id,
               CASE doc_id % 6 WHEN 2 THEN {CATCH_ALL} WHEN 4 THEN 'a@x.org'
                    ELSE 'user' || doc_id || '@example.com' END AS reply_to,
               CASE doc_id % 6 WHEN 2 THEN 'N/A' WHEN 4 THEN 'a@x.org'
                    ELSE 'user' || doc_id || '@example.com' END AS sender,
               CASE doc_id % 6 WHEN 2 THEN 'N/A' WHEN 4 THEN 'b@x.org' ELSE '{s.RECIPIENT}' END AS recipient,
               CASE doc_id % 6 WHEN 2 THEN 'No Subject Detected' WHEN 4 THEN 'Übung ' || doc_id ELSE 'Fwd' END AS subject,
               CASE doc_id % 6 WHEN 0 THEN 'please check' WHEN 1 THEN text || lang WHEN 5 THEN 'please check'
                    WHEN 3 THEN regexp_replace(text, '[^\\x00-\\x7F]', chr(65533), 'g') ELSE text END AS body
        FROM documents""",
    "notification_status": """
        SELECT doc_id AS msg_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 500 ELSE 200 END AS status FROM documents""",
    "intake_status": """
        SELECT doc_id AS msg_id, CASE WHEN doc_id % 5 = 0 THEN 500 ELSE 200 END AS status
        FROM documents WHERE doc_id % 5 = 0 OR doc_id % 6 IN (3, 4)""",
    "score_hook": """
        SELECT doc_id AS msg_id, doc_id % 4 = 0 AS is_phishing,
               CASE doc_id % 4 WHEN 0 THEN 'PHISHING' WHEN 1 THEN 'CLEAN' ELSE '' END AS label,
               CASE doc_id % 4 WHEN 2 THEN 'Error: Unexpected error occurred during email classification.'
                    WHEN 3 THEN 'Error: Unable to process the email content. (429)' END AS score_error
        FROM documents""",
    "prompt_table": f"""
        WITH {MAIL}
        SELECT msg_id, {fill(PROMPT_TEMPLATE, today="'March 05, 2024'", mail="envelope")} AS prompt
        FROM mail""",
    "model_request": f"""
        WITH {MAIL}
        SELECT msg_id, 'bedrock-2023-05-31' AS version, 2000 AS max_tokens, 0.7::DOUBLE AS temperature,
               'user' AS role,
               {fill(PROMPT_TEMPLATE, today="'March 05, 2024'", mail="envelope")} AS content
        FROM mail""",
    "score_join": f"""
        WITH {MAIL}
        SELECT msg_id, subject, msg_id % 10 <> 7 AS answered,
               CASE WHEN msg_id % 20 = 7 THEN 'ThrottlingException' END AS error_code
        FROM mail""",
    "response_text": f"""
        WITH {ANSWERS}
        SELECT msg_id, CASE WHEN msg_id % 20 <> 7 THEN text END AS text
        FROM answers WHERE msg_id % 10 <> 7 OR msg_id % 20 = 7""",
    "scored_errors": f"WITH {SECTIONS} SELECT msg_id, is_phishing, label, score_error FROM judged",
    "verdict_flag": f"WITH {ANSWERS} SELECT msg_id, is_phishing FROM flags",
    "verdict_label": f"WITH {ANSWERS} SELECT msg_id, label FROM flags",
    "section_items": f"WITH {SECTIONS} SELECT msg_id, section, pos::INT AS pos, item FROM items",
    "bold_items": f"""
        WITH split AS (SELECT doc_id, string_split(text, {NL}) AS lines FROM documents),
        rows AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM split)
        SELECT doc_id, pos::INT AS pos, {item("line")} AS item FROM rows""",
    "section_html": f"WITH {SECTIONS} SELECT msg_id, analysis FROM analyses",
    "reply_subject": f"WITH {TRIAGE} SELECT msg_id, reply_subject FROM triaged",
    "report_html": f"WITH {SECTIONS} SELECT msg_id, {report('is_phishing', 'analysis')} AS report FROM analyses",
    "html_to_text": f"SELECT page_id, {plain_text('html')} AS text FROM pages",
    "redact_documents": f"""
        WITH extended AS (
            SELECT doc_id, text || ' call 555-' || lpad((doc_id % 1000)::VARCHAR, 3, '0')
                   || '-4567 ssn 123-45-' || lpad((doc_id % 10000)::VARCHAR, 4, '0')
                   || ' see https://ex.example.com/' || doc_id AS text
            FROM documents)
        SELECT doc_id, {redacted("text")} AS redacted FROM extended""",
    "redact_pages": f"SELECT page_id, {redacted('html')} AS redacted FROM pages",
    "catch_all_routed": f"WITH {MAIL} SELECT msg_id, reply_to, subject FROM mail WHERE reply_to = {CATCH_ALL}",
    "tickets": f"""
        WITH {TRIAGE}
        SELECT msg_id,
               CASE WHEN is_phishing THEN '[PHISHING] ' ELSE '[CLEAN] ' END || reply_subject AS title,
               {fill(TICKET_TEMPLATE, verdict="CASE WHEN is_phishing THEN 'PHISHING' ELSE 'CLEAN' END",
                     time="'2024-03-05 06:07:08'", mail=redacted("envelope"))} AS body,
               'phishing-email,catch-all' AS labels
        FROM triaged WHERE reply_to = {CATCH_ALL}""",
    "processing_status": """
        SELECT doc_id AS msg_id, CASE WHEN broken THEN 500 ELSE 200 END AS status,
               CASE WHEN broken THEN '"Error processing email: unknown encoding: bogus-1"'
                    ELSE '"Email processed successfully"' END AS status_body,
               CASE WHEN broken THEN 'unknown encoding: bogus-1' END AS error
        FROM (SELECT doc_id, doc_id % 6 = 1 AND doc_id % 5 = 0 AS broken FROM documents)""",
    "outbox": f"""
        WITH {TRIAGE},
        replies AS (SELECT *, {report('is_phishing', 'analysis')} AS html FROM triaged)
        SELECT msg_id, 'noreply@triage.example.com' AS sender, reply_to AS recipient,
               reply_subject AS subject, html AS body_html, {plain_text("html")} AS body_text,
               'AWS-SES-Send-Email' AS config_set
        FROM replies""",
    "outbox_text": f"""
        WITH {TRIAGE}
        SELECT msg_id, reply_to AS recipient, reply_subject AS subject, NULL::VARCHAR AS body_html,
               {report('is_phishing', 'analysis')} AS body_text
        FROM triaged""",
    "sender_default": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '@example.org'
                            WHEN doc_id % 2 = 0 THEN 'noreply@' || source || '.example.net'
                            ELSE 'noreply@example.com' END AS sender
        FROM documents""",
    "triage_batch": f"WITH {TRIAGE} SELECT {_DECISION} FROM triaged",
    "event_stream": f"""
        WITH {TRIAGE},
        events AS (
            SELECT doc_id, doc_id * 2 AS event_id FROM documents
            UNION ALL SELECT doc_id, doc_id * 2 + 1 FROM documents WHERE doc_id % 8 = 0
        )
        SELECT event_id, doc_id % 4 IN (0, 3) AS processed,
               CASE WHEN doc_id % 4 IN (0, 3) THEN reply_to END AS reply_to,
               CASE WHEN doc_id % 4 IN (0, 3) THEN reply_subject END AS reply_subject,
               CASE WHEN doc_id % 4 IN (0, 3) THEN is_phishing END AS is_phishing
        FROM events JOIN triaged ON msg_id = doc_id""",
    "object_listing_source": f"""
        WITH {OBJECTS}, sized AS (SELECT key, strlen(text)::BIGINT AS size FROM objects JOIN documents USING (doc_id))
        SELECT key, size, CASE WHEN size < 1024 THEN printf('%.2f B', size::DOUBLE)
                               WHEN size < 1048576 THEN printf('%.2f KB', size / 1024::DOUBLE)
                               ELSE printf('%.2f MB', size / 1048576::DOUBLE) END AS label
        FROM sized""",
    "replay_outcomes": """
        SELECT doc_id || CASE WHEN toxic = 1 THEN '.gone' ELSE '.eml' END AS msg_id,
               CASE WHEN toxic = 1 THEN 500 ELSE 200 END AS status,
               CASE WHEN toxic = 1 THEN '"Error processing email: no such object: ' || doc_id || '.gone"'
                    ELSE '"Email processed successfully"' END AS status_body
        FROM labels""",
    "work_units": f"""
        WITH {OBJECTS}
        SELECT key, size,
               floor(coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     / {q.UNIT_BYTES})::BIGINT AS unit
        FROM objects""",
    "stored_listing": f"""
        WITH {OBJECTS}
        SELECT r.key, r.doc_id, EXISTS (SELECT 1 FROM objects o WHERE o.key = r.key) AS stored FROM requested r""",
    "score_resumed": """
        SELECT doc_id AS msg_id, CASE WHEN doc_id % 2 = 1 THEN 'PHISHING' ELSE 'CLEAN' END AS label,
               CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS run
        FROM documents""",
    "compacted_outbox": f"""
        WITH {TRIAGE}
        SELECT msg_id, (msg_id % 4)::BIGINT AS batch_id, reply_to AS recipient, reply_subject AS subject,
               {plain_text(report('is_phishing', 'analysis'))} AS body_text
        FROM triaged""",
    "outcome_counts": """
        SELECT (doc_id % 2)::BIGINT AS batch_id, count(*) FILTER (doc_id % 5 <> 0) AS succeeded,
               count(*) FILTER (doc_id % 5 = 0) AS failed
        FROM documents GROUP BY 1""",
}
