"""Codes of single texts on the command line: python -m wayfare.cli encode|decode TEXT... [--alphabet N] [--json].

The predictor knows no texts (all bytes weigh the same), so this shows the format; tables are coded with operators.predict.
Exit codes: 0 done, 1 a text or code that cannot be handled, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np

from .operators.coding import bits_to_code, code_to_bits, digits_of
from .operators.predict import ByteTokens, CountPredictor, decode_bits, encode_text


def encode_one(text: str, alphabet: int) -> dict:
    if not text.strip():
        raise ValueError("an empty text")
    bits, steps = encode_text(CountPredictor({}, {}, np.ones(257)), ByteTokens.encode(text))
    return {"ok": True, "text": text, "code": bits_to_code(bits, 0, digits_of(alphabet)), "bits": len(bits), "tokens": len(steps)}


def decode_one(code: str, alphabet: int) -> dict:
    version, bits = code_to_bits(code.strip(), digits_of(alphabet))
    if version:
        raise ValueError(f"stream version {version} is not 0")
    return {"ok": True, "code": code, "text": ByteTokens.decode(decode_bits(CountPredictor({}, {}, np.ones(257)), bits))}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wayfare")
    parser.add_argument("what", choices=["encode", "decode"])
    parser.add_argument("texts", nargs="+")
    parser.add_argument("--alphabet", type=int, default=1, choices=[0, 1, 3])
    parser.add_argument("--json", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    status = 0
    for text in args.texts:
        try:
            out = (encode_one if args.what == "encode" else decode_one)(text, args.alphabet)
            line = out["code" if args.what == "encode" else "text"]
        except ValueError as e:  # bytes that are no text, too
            out, line, status = {"ok": False, "error": str(e)}, "", 1
            print(f"{text!r}: {e}", file=sys.stderr)
        if args.json:
            print(json.dumps(out, ensure_ascii=False))
        elif line:
            print(line)
    return status


if __name__ == "__main__":
    sys.exit(main())
