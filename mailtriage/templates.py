"""Wording of the prompt, the HTML report and the ticket. Slots are written ``{name}``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMPT_TEMPLATE = """\
You review e-mail for an IT security team. Decide whether the message below is phishing or legitimate.

Answer format:
1. The first line holds the verdict alone: PHISHING or CLEAN.
2. After a PHISHING verdict write these two sections:
[SECTION]RED FLAGS[/SECTION]
(what is suspicious in this message)
[SECTION]HOW TO IDENTIFY SIMILAR THREATS[/SECTION]
(how a reader can recognise mail of this kind)
   After a CLEAN verdict write this one section:
[SECTION]CLEAN INDICATORS[/SECTION]
(why the message looks legitimate)
3. Each section has 5-8 bullets starting with "-". A bullet is one short sentence about one point. No paragraphs.

Judge the original message only: sender address and domain, wording and urgency, link targets, attachments and
requests, and whether the content fits its context. Say nothing about who forwarded it, how it was forwarded, or
this review service.

Date of review: {today}

Message under review:

{mail}
"""

REPORT_TEMPLATE = """\
<html>
<head>
<style>
body { font-family: Helvetica, Arial, sans-serif; max-width: 48em; margin: 1em auto; color: #222; }
.banner { background: {accent}; color: #fff; padding: 0.8em; text-align: center; }
.findings { border-left: 5px solid {accent}; background: #fafafa; padding: 0.8em; }
.verdict { background: {tint}; padding: 0.5em; }
.red-section { color: #b71c1c; }
.green-section { color: #1b5e20; }
.closing { border-top: 1px solid #ddd; color: #666; font-size: 0.85em; }
</style>
</head>
<body>
<div class="banner"><h1>{heading}</h1></div>
<div class="findings">
<h2>What we found</h2>
<div class="analysis">
{analysis}
</div>
</div>
<div class="closing">
<p>An automated review produced this report.</p>
<p>Please ask your IT help desk if anything is unclear.</p>
</div>
</body>
</html>
"""

REPORT_THEME = {
    True: {"accent": "#c62828", "tint": "#fdecea", "heading": "Warning: this message is phishing"},
    False: {"accent": "#2e7d32", "tint": "#edf7ed", "heading": "No phishing found in this message"},
}

TICKET_TEMPLATE = """\
### Mail triage result

- Classification: {verdict}
- Time: {time}

### Reported message (redacted)

```
{mail}
```

Opened because the reply address of this message is the catch-all mailbox.
"""


def pieces(template: str, slots: tuple[str, ...]) -> list[tuple[str, bool]]:
    """Cut a template at the named slots: ``(text, False)`` for fixed text, ``(name, True)`` for a slot."""
    cut = re.split("({" + "}|{".join(slots) + "})", template)
    return [(p[1:-1], True) if p.startswith("{") and p[1:-1] in slots else (p, False) for p in cut if p]


def fill(template: str, **slots: Column | str) -> Column:
    """The template as one ``concat`` of literals and columns; null when a slot column is null."""
    parts = pieces(template, tuple(slots))
    values = (slots[text] if is_slot else text for text, is_slot in parts)
    return F.concat(*(F.lit(v) if isinstance(v, str) else v for v in values))
