"""Readers that tolerate absent stores and older schemas."""
