"""Index upkeep from a stream."""
