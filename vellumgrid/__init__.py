"""Document retrieval and graph question answering as DataFrame plans."""
