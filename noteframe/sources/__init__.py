"""Sources and sinks: delimited note files, annotation exports, registers,
CoNLL / per-patient / chunked / flat exports and stage persistence."""
