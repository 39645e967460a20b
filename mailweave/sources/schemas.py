"""Schemas of the records."""

from __future__ import annotations

MAIL = (
    "message_id string, sender_name string, sender_address string, recipients array<string>, cc array<string>, date timestamp, date_local timestamp_ntz, date_str string, subject string, body string, "
    "source_file string, attachments array<string>, error string"
)
# Field names of the request and names of the CRM's objects are those of their senders.
REQUEST = (
    "emails array<struct<message_id: string, subject: string, body: string, sender_email: string, date_str: string, sender_name: string, recipients: array<string>, cc: array<string>>>, "
    "use_local_ai boolean, ai_model_name string"
)
CRM_MESSAGE = "id string, parent_id string, related_to_id string, from_address string, from_name string, to_address string, cc_address string, subject string, text_body string, html_body string, message_date timestamp"
SPEC = "category string, raw_match string, value string, unit string, subject string, context string, mentioned_by string, mentioned_address string, date_str string, source_file string"
