"""The patterns that decide what counts as a fact, for Java's regular expressions.

``B`` is a word border and ``S`` white space as the patterns' source language defines them: Java's own are
wider and narrower.
"""

B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
S = r"[\s   -     　﻿]"
NOT_S = r"[^\s   -     　﻿"



def word(first: str) -> str:
    """``B`` before a word that starts with one of these letters; a look at the letter settles most places."""
    return rf"(?=[{first}])(?<!\w)"


# Identifiers as they are written in evidence. A leading ``(?=...)`` changes no match: it fails early where the rest would.
PHONE = r"(?=[+\d])(?:(?<![\w+])(?:(?:\+91|91)[ -]?|0)?[6-9]\d{4}[ -]?\d{5}(?!\d)|(?<![\w+])\+(?!91)\d{8,15}(?!\d))"
URL = rf"(?i){word('h')}https?://{NOT_S}<>\"'`]+"
BARE_HOST = rf"(?i)(?<![\w.@/:-])(?=[a-z0-9-]++\.)((?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+([a-z]{{2,24}}))(?![\w@-])(?::\d{{2,5}})?(?:/{NOT_S}<>\"'`]*)?"
URL_TAIL = r"[.,;:!?)\]}>'\"]+$"
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"
UPI_ID = r"(?<![\w.-])[A-Za-z0-9._-]{2,}+@[A-Za-z][A-Za-z0-9]{1,}(?![A-Za-z0-9@-])(?!\.[A-Za-z0-9])"
AMOUNT = rf"(?i)(?=[₹ri])(?<![A-Za-z0-9])(?:₹|Rs\.?|INR){S}?(?:\d{{1,3}}(?:,\d{{2}})*,\d{{3}}|\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d{{2}})?(?!\d)(?!,\d)"
TRANSACTION_LABEL = r"(?:UTR|UPI Ref No|Ref No|Reference No|RRN|Transaction ID|Txn ID)"
TRANSACTION = rf"(?i){word('urt')}{TRANSACTION_LABEL}{B}\.?{S}*[:.#]?{S}*([A-Z0-9]{{8,22}})(?![A-Z0-9])"
ACCOUNT_HINT = rf"(?i){word('ae')}(?:(?:A/c|Acct|account)(?:{S}+(?:ending{S}+in|ending|no\.?|number))?{S}*[:.#-]?{S}*[Xx*]{{2,}}\d{{3,4}}(?!\d)|ending{S}+(?:in{S}+)?\d{{4}}(?!\d))"
SMS_SENDER = r"^[A-Z]{2}-[A-Z0-9]{3,9}$"
HANDLE = rf"(?=[@t])(?:(?<![\w.@/-])@[A-Za-z0-9_][A-Za-z0-9_.]{{2,31}}(?<!\.)(?![\w@])|(?<!\w)t\.me/[A-Za-z0-9_]{{3,32}}(?!\w))"
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref_src)$"

# Names after their labels.
NAME = r"(?-i:\p{L}[\p{L}\p{M}.'&-]*(?: \p{Lu}[\p{L}\p{M}.'&-]*){0,4})"
PERSON_LABEL = rf"(?i){word('pn')}(?:Paid by|Paid to|Name){S}*:{S}*"
BANK_LABEL = rf"(?i){word('bw')}(?:Bank(?:{S}+name)?|Wallet){S}*:{S}*"
DEBITED_NAME = rf"((?:[A-Z][A-Za-z&.'-]*{S}+){{1,4}}Bank)$"
DEBITED_FROM = rf"{word('Dd')}[Dd]ebited{S}+from{S}+(?:[A-Z][A-Za-z&.'-]*{S}+){{1,4}}Bank{B}"

# What is redacted before anything else reads a line.
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
#: Cards that stand as words: no letter or digit touches them, as one does within a key of hex digits.
CARD_WORD = r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"
ACCOUNT_CUE = rf"(?i)(?:{B}a/c(?:{S}*no\.?)?|{B}account{S}*(?:no|number)\.?|{B}acct(?:{S}*no\.?)?){S}*[:.#-]?{S}*\d{{9,18}}(?!\d)"
OTP_CUE = rf"(?i){B}(?:otp|one[ -]time password|verification code|security code|code is|pin is){B}"
DIGIT_RUN = r"(?<!\d)\d+(?:[ -]\d+)?(?!\d)"
PHONE_LIKE = r"(?<![\d+])\+?\d(?:[ -]?\d){9,12}(?!\d)"
AMOUNT_BEFORE = rf"(?i)(?:₹|rs\.?|inr){S}*$"
LABEL_BEFORE = rf"(?i)(?:utr|upi ref no|ref no|reference no|rrn|transaction id|txn id){S}*[:.#]?{S}*$"
CUE_DISTANCE = 30

# Cues that relate two facts of one item.
PAYEE_CUE = rf"(?i){B}paid{S}+to{B}|{B}to{S}+VPA{B}"
UPI_CUE, RECEIPT_CUE = rf"(?i){B}UPI{S}+ID{S}*:", rf"(?i){B}(?:receipt|payment{S}+successful){B}"
DEBIT_CUE = rf"(?i){B}debited{S}+from{B}|{B}from{S}+account{B}|{B}A/c{B}[^\n]*{B}debited{B}"

# Whole values of a type, and the parts of them that make its canonical form.
PHONE_SEPARATORS = r"[\s\-().]"
MOBILE, ABROAD = r"^(?:\+91|91|0)?([6-9]\d{9})$", r"^\+(\d{8,15})$"
RUPEES, PAISE, HINT = r"(?i)^(?:₹|Rs\.?|INR)\s?([\d,]+)", r"\.(\d{2})$", r"(\d{3,4})$"
WHOLE_UPI_ID, WHOLE_TRANSACTION = r"^[A-Za-z0-9._-]{2,}@[A-Za-z][A-Za-z0-9]+$", r"^(?=.*\d)[A-Za-z0-9]{8,22}$"
WHOLE_HINT, WHOLE_NAME = r"^[Xx*]{2,}\d{3,4}$|^(?i:ending\s+(?:in\s+)?\d{4})$", r"^\p{L}[\p{L}\p{M} .'&-]{0,79}$"
WHOLE_DOMAIN = r"(?i)^(?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?\.)+[\p{L}\p{M}\p{N}-]{2,63}$"
HANDLE_START = r"(?i)^@|^t\.me/"
# What a mask shows of a phone number.
SHOWN_MOBILE, SHOWN_AS, SHOWN_ABROAD = r"^\+91(\d{2})\d{5}(\d{3})$", r"+91 $1XXX XX$2", r"^\+\d{3}(\d+)\d{3}$"
