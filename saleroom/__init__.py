"""Marketplace analytics on Spark: listings, auctions, sales, messages, notifications."""
