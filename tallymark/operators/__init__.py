"""Operators over tables of scans: extraction, matching, comparison, rules, recognised words, barcodes, image features."""
