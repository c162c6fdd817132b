"""Lets the tests of this folder import its fixtures, wherever pytest is started."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_fixtures", Path(__file__).with_name("fixtures.py"))
fixtures = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(fixtures)
