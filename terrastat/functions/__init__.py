from .codes import (
    AREA_PREFIX,
    is_glued_key_reject,
    is_location_reject,
    location_department,
    location_province,
    split_glued_key,
)
from .numbers import is_missing, is_number, to_number, to_whole
from .text import email_domain, first_email, trim_unicode

__all__ = [
    "AREA_PREFIX",
    "email_domain",
    "first_email",
    "is_glued_key_reject",
    "is_location_reject",
    "is_missing",
    "is_number",
    "location_department",
    "location_province",
    "split_glued_key",
    "to_number",
    "to_whole",
    "trim_unicode",
]
