"""codesieve: source-code security analytics on Spark DataFrames."""

from codesieve.options import ScanOptions
from codesieve.plans.scan import Scan, scan_table, scan_tree

__all__ = ["Scan", "ScanOptions", "scan_table", "scan_tree"]
