"""Scans as a stream: each upload is evaluated by itself, so no state and no watermark is needed."""
