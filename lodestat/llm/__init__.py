"""Training-data operators over documents and conversations.

Nothing else in the library imports this subpackage.
"""
