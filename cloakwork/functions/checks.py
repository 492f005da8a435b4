"""Check digits of identifiers as SQL expressions: pure, without UDFs."""

from __future__ import annotations

from .dialect import LOWER, UPPER, Dialect

#: Fixed values of the standards.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VALUES36 = "0123456789" + LETTERS
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CN_CHECKS = "10X98765432"
#: Weights of 0-9 and A-Z at odd places of a codice fiscale, two digits each.
CF_ODD = "010005070913151719210100050709131517192102041820110306081214161022252423"
#: Length of an IBAN by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def _digit(v: str, i: str = "i") -> str:
    return f"cast(substr({v}, cast({i} as int), 1) as int)"


def _value(v: str, alphabet: str, i: str = "i") -> str:
    return f"(instr('{alphabet}', substr({v}, cast({i} as int), 1)) - 1)"


def _upper(v: str) -> str:
    return f"translate({v}, '{LOWER}', '{UPPER}')"


def strip(v: str) -> str:
    return f"replace(replace({v}, ' ', ''), '-', '')"


def luhn(d: Dialect, v: str) -> str:
    x = _digit(v)
    term = f"case when (length({v}) - i) % 2 = 1 then 2 * {x} - case when {x} > 4 then 9 else 0 end else {x} end"
    return f"(case when {d.test(v, '^[0-9]{2,}$')} then {d.total(f'length({v})', term)} % 10 = 0 else false end)"


def network(v: str) -> str:
    n, p = f"length({v})", lambda k: f"substr({v}, 1, {k})"
    return (
        f"(case when {p(1)} = '4' and {n} in (13, 16, 19) then 'Visa' when ({p(2)} between '51' and '55' or {p(4)} between '2221' and '2720') and {n} = 16 then 'Mastercard' "
        f"when {p(2)} in ('34', '37') and {n} = 15 then 'Amex' when {p(2)} = '62' and {n} between 16 and 19 then 'UnionPay' when {p(4)} between '3528' and '3589' and {n} between 16 and 19 then 'JCB' "
        f"when ({p(2)} in ('36', '38', '39') or {p(3)} between '300' and '305') and {n} in (14, 16, 19) then 'Diners' "
        f"when ({p(4)} = '6011' or {p(2)} = '65' or {p(6)} between '622126' and '622925') and {n} in (16, 19) then 'Discover' "
        f"when {p(4)} in ('5018', '5020', '5038', '6304', '6759', '6761', '6762', '6763') and {n} between 12 and 19 then 'Maestro' else '' end)"
    )


def card(d: Dialect, v: str) -> str:
    return f"({d.test(v, '^[0-9]{12,19}$')} and {network(v)} <> '' and {luhn(d, v)})"


def card_luhn(d: Dialect, v: str) -> str:
    return f"({d.test(v, '^[0-9]{12,19}$')} and {luhn(d, v)})"


def cn_id(d: Dialect, v: str) -> str:
    v = _upper(v)
    s = d.total("17", f"{_digit(v)} * (cast(power(2, 18 - i) as int) % 11)")
    ok = f"cast(substr({v}, 11, 2) as int) between 1 and 12 and cast(substr({v}, 13, 2) as int) between 1 and 31 and substr('{CN_CHECKS}', cast({s} % 11 as int) + 1, 1) = substr({v}, 18, 1)"
    return f"(case when {d.test(v, '^[0-9]{17}[0-9X]$')} then {ok} else false end)"


def uscc(d: Dialect, v: str) -> str:
    s = d.total("17", f"{_value(v, USCC_ALPHABET)} * (cast(power(3, i - 1) as bigint) % 31)")
    return f"(case when {d.test(v, f'^[{USCC_ALPHABET}]{{18}}$')} then substr('{USCC_ALPHABET}', cast((31 - {s} % 31) % 31 as int) + 1, 1) = substr({v}, 18, 1) else false end)"


def iban(d: Dialect, v: str) -> str:
    turned = f"(substr({v}, 5) || substr({v}, 1, 4))"
    rest = d.fold(f"length({v})", _value(turned, VALUES36), 0, "(acc * case when x > 9 then 100 else 10 end + x) % 97")
    at = f"instr('{IBAN_LENGTHS}', substr({v}, 1, 2))"
    return f"(case when {d.test(v, '^[A-Z]{2}[0-9]{2}[A-Z0-9]+$')} and {at} > 0 then cast(substr('{IBAN_LENGTHS}', {at} + 2, 2) as int) = length({v}) and {rest} = 1 else false end)"


def codice_fiscale(d: Dialect, v: str) -> str:
    v = _upper(v)
    odd = f"cast(substr('{CF_ODD}', cast(2 * {_value(v, VALUES36)} + 1 as int), 2) as int)"
    even = f"(case when {_value(v, VALUES36)} > 9 then {_value(v, VALUES36)} - 10 else {_value(v, VALUES36)} end)"
    s = d.total("15", f"case when i % 2 = 1 then {odd} else {even} end")
    return f"(case when {d.test(v, '^[A-Z0-9]{15}[A-Z]$')} then substr('{LETTERS}', cast({s} % 26 as int) + 1, 1) = substr({v}, 16, 1) else false end)"


def steuer_id(d: Dialect, v: str) -> str:
    times = f"(10 - length(replace(substr({v}, 1, 10), cast(i - 1 as varchar(1)), '')))"
    twice, thrice, more = (d.total("10", f"case when {times} {x} then 1 else 0 end") for x in ("= 2", "= 3", "> 3"))
    runs = d.total("10", f"case when {times} = 3 and instr(substr({v}, 1, 10), repeat(cast(i - 1 as varchar(1)), 3)) > 0 then 1 else 0 end")
    p = d.fold("10", _digit(v), 10, "(2 * case when (x + acc) % 10 = 0 then 10 else (x + acc) % 10 end) % 11")
    return f"(case when {d.test(v, '^[1-9][0-9]{10}$')} then {twice} + {thrice} = 1 and {more} = 0 and {runs} = 0 and (11 - {p}) % 10 = {_digit(v, '11')} else false end)"


def dni(d: Dialect, v: str) -> str:
    v = _upper(strip(v))
    number = f"cast(replace(replace(replace(substr({v}, 1, 8), 'X', '0'), 'Y', '1'), 'Z', '2') as int)"
    return f"(case when {d.test(v, '^[XYZ0-9][0-9]{7}[A-Z]$')} then substr('{DNI_LETTERS}', {number} % 23 + 1, 1) = substr({v}, 9, 1) else false end)"


CHECKS = {"luhn": luhn, "card": card, "card_luhn": card_luhn, "cn_id": cn_id, "uscc": uscc, "iban": iban, "codice_fiscale": codice_fiscale, "steuer_id": steuer_id, "dni": dni}
