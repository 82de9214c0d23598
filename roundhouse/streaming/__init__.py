"""The same operators over live events."""
