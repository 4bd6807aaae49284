"""DataFrame operators over documents: hit tests, layout, editing and history."""
